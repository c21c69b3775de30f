import datetime
import json

import pytest
from pyspark.sql import functions as F

from slidewatch.operators import gold, joins, metrics, silver
from slidewatch.settings import NOTE_LABELS

D = datetime.date
SEGMENTS = "segment_id string, cohort string, platform string, region string, mau int, segment_summary string, is_active boolean"
EXPERIMENTS = (
    "experiment_id string, experiment_name string, variant string, feature_area string, tested_cohort string, "
    "tested_platform string, won boolean, observed_lift double, description string, is_active boolean"
)


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame(
        [
            ("SEG-1", "gen_z", "android", "EMEA", 420000, "", True),
            ("SEG-2", "boomer", "android", "EMEA", 1000, "", True),
            ("SEG-3", "gen_z", "web", "APAC", 2000, "", True),
        ],
        SEGMENTS,
    )


@pytest.fixture(scope="module")
def snapshots(spark):
    rows = [
        ("SEG-1", D(2024, 1, 1), 0.042, 10, "needs a rollback or a proven variant"),
        ("SEG-1", D(2024, 1, 20), 0.029, 10, "android funnel regressed, ios fine"),
        ("SEG-2", D(2024, 1, 20), 0.01, 10, None),
        ("SEG-3", D(2024, 1, 5), 0.04, 10, "converting to plan"),
        ("SEG-3", D(2024, 1, 20), 0.035, 10, "something nobody expected"),
        ("SEG-3", D(2023, 1, 1), 0.9, 10, None),
    ]
    return spark.createDataFrame(rows, "segment_id string, snapshot_date date, conversion_rate double, sessions int, pm_note_text string")


@pytest.fixture(scope="module")
def events(spark):
    rows = [("SEG-1", D(2024, 1, 20), f"S{i}", i == 0, 12.5 if i == 0 else 0.0) for i in range(4)]
    rows += [("SEG-9", D(2024, 1, 20), "S9", True, 1.0)]
    return spark.createDataFrame(rows, "segment_id string, event_date date, session_id string, converted boolean, revenue_usd double")


@pytest.fixture(scope="module")
def experiments(spark):
    def row(i, area, cohort, platform, won, lift):
        return (i, "", "variant_a", area, cohort, platform, won, lift, "", True)

    rows = [
        row("EXP-9", "checkout", "gen_z", "android", True, 0.0225),
        row("EXP-2", "checkout", "gen_z", "android", True, 0.0225),
        row("EXP-3", "checkout", "gen_z", "android", False, 0.9),
        row("EXP-4", "pricing", "gen_z", "web", True, 0.5),
    ]
    return spark.createDataFrame(rows, EXPERIMENTS)


@pytest.fixture(scope="module")
def flags(spark):
    rows = [
        ("F1", "SEG-1", "checkout", "own_flow", "variant_a", 100, D(2024, 1, 1)),
        ("F2", "SEG-2", "checkout", "old_flow", "control", 100, D(2023, 1, 1)),
        ("F3", "SEG-2", "checkout", "new_flow", "variant_b", 50, D(2024, 1, 1)),
        ("F4", "SEG-2", "checkout", "tied_flow", "variant_b", 25, D(2024, 1, 1)),
    ]
    return spark.createDataFrame(rows, "flag_id string, segment_id string, feature_area string, flag_key string, variant string, rollout_pct int, updated_date date")


@pytest.fixture(scope="module")
def position(spark, segments, snapshots, events):
    conv = silver.silver_conv(snapshots, segments, silver.note_slide_flags(snapshots))
    return gold.segment_position(conv, silver.silver_events(events, segments), "2024-01-20")


def by_id(df):
    return {r["segment_id"]: r for r in df.collect()}


def test_notes_are_labelled_once(snapshots):
    rows = {r["pm_note_text"]: (r["label"], r["slide_signal_score"]) for r in silver.note_slide_flags(snapshots).collect()}
    assert rows["converting to plan"] == ("healthy", 0.1)
    assert rows["something nobody expected"] == ("at_risk", 0.6)
    assert rows["android funnel regressed, ios fine"] == ("sliding", 1.0)
    assert None not in rows


def test_all_known_notes_have_a_label(spark):
    notes = spark.createDataFrame([(n,) for n in NOTE_LABELS], "pm_note_text string")
    got = {r["pm_note_text"]: r["label"] for r in silver.note_slide_flags(notes).collect()}
    assert got == NOTE_LABELS


def test_position(position):
    rows = by_id(position)
    one = rows["SEG-1"]
    assert (one["conversion_rate"], one["conversion_rate_3w_ago"], one["conversion_drop"]) == (0.029, 0.042, 0.013)
    assert one["conv_band"] == "sliding" and one["sessions"] == 4
    assert one["conversion_at_risk_usd"] == pytest.approx(524160.0)
    assert rows["SEG-2"]["conversion_drop"] == 0.0 and rows["SEG-2"]["conv_band"] == "healthy"
    assert rows["SEG-2"]["slide_signal_score"] is None and rows["SEG-2"]["sessions"] == 0
    assert rows["SEG-3"]["conv_band"] == "watch"  # the old 0.9 lies outside the window


def test_events_of_unknown_segments_are_left_out(events, segments):
    rows = silver.silver_events(events, segments).collect()
    assert [(r["segment_id"], r["sessions"], r["conversions"], r["conversion_rate"], r["revenue"]) for r in rows] == [("SEG-1", 4, 1, 0.25, 12.5)]


def test_current_flag_is_the_latest(flags):
    rows = {(r["segment_id"], r["flag_key"]) for r in silver.silver_flags(flags).collect()}
    assert rows == {("SEG-1", "own_flow"), ("SEG-2", "new_flow")}


def test_open_sliding_and_recommendation(spark, position, experiments, flags, segments):
    open_rows = gold.open_sliding(position, experiments, silver.silver_flags(flags), segments)
    rows = by_id(open_rows)
    assert set(rows) == {"SEG-1", "SEG-3"}
    assert rows["SEG-1"]["matching_experiment_id"] == "EXP-2"  # equal lift: smaller id
    assert rows["SEG-1"]["neighbor_flag_key"] == "new_flow"  # not its own
    assert not rows["SEG-3"]["has_matching_experiment"] and rows["SEG-3"]["neighbor_flag_key"] is None
    recs = by_id(gold.recommendations(open_rows, "2024-01-21 00:00:00"))
    nets = [o["net_value_usd"] for o in recs["SEG-1"]["action_ranking"]]
    assert nets == [pytest.approx(630040.0), pytest.approx(241420.0), pytest.approx(156280.0)]
    assert recs["SEG-1"]["recommended_action"] == "ship_proven_variant"
    assert recs["SEG-3"]["recommended_action"] == "rollout_existing_flag"


def test_neighbor_of_the_best_cohort_is_the_second_best(spark, position, flags, segments):
    near = by_id(gold.neighbor_flag(position, silver.silver_flags(flags), segments))
    assert near["SEG-2"]["neighbor_flag_key"] == "own_flow"
    assert near["SEG-1"]["neighbor_flag_key"] == "new_flow"


def test_ranking_text(spark):
    good = '[{"action_type":"a","conversion_lift":0.1,"ship_cost_usd":5.0,"net_value_usd":7.0}]'
    rows = [(good, 1), (json.dumps(good), 1), ("{broken", 0), ("", 0), (None, 0), ("7", 0), ('{"action_type":"a"}', 0), ("[]", 0)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", F.size(gold.parse_ranking(F.col("t"))).alias("n")).collect()}
    assert [got[i] for i in range(len(rows))] == [n for _, n in rows]


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (-1, "b")], "n int, s string")
    rules = {"positive": F.col("n") > 0, "named": F.col("s") != ""}
    kept, counted = silver.expect(df, rules)
    assert [r["n"] for r in kept.collect()] == [1]
    assert {(r["rule"], r["passed"], r["failed"]) for r in counted.collect()} == {("positive", 2, 1), ("named", 2, 1)}
    assert silver.expect(df, rules, "warn")[0].count() == 3
    with pytest.raises(ValueError, match="positive"):
        silver.expect(df, rules, "fail")


def test_forecast_is_seeded_once(spark):
    known = spark.createDataFrame([("a", 0.1)], "segment_id string, lift double")
    new = spark.createDataFrame([("a", 0.9), ("b", 0.2)], "segment_id string, lift double")
    once = gold.seed_forecast(known, new)
    assert sorted(map(tuple, once.collect())) == [("a", 0.1), ("b", 0.2)]
    assert gold.seed_forecast(once, new).count() == 2


def test_stored_metrics_give_the_same_measures(position):
    stored = metrics.materialize_metrics(position)
    for dims in ([], ["platform"], ["cohort", "region"]):
        a = metrics.rollup_from(stored, dims)
        b = metrics.segment_metrics(position, dims)
        left = {tuple(r[d] for d in dims): r.asDict() for r in a.collect()}
        right = {tuple(r[d] for d in dims): r.asDict() for r in b.collect()}
        assert left.keys() == right.keys()
        for key, row in left.items():
            for name, cell in row.items():
                assert cell == pytest.approx(right[key][name]), (key, name)


def test_metrics_reject_unknown_dimensions(position):
    with pytest.raises(ValueError, match="mau"):
        metrics.segment_metrics(position, ["mau"])


def test_broadcast_only_within_the_limit(spark):
    big, dim = spark.range(1000), spark.range(3).withColumn("name", F.lit("x"))
    plan = lambda limit: joins.broadcast_dim(big, dim, "id", limit)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(10**9) and "broadcast" not in plan(1)


def test_scalar_of_an_empty_table_is_null(spark):
    empty = spark.range(0).agg(F.sum("id").alias("total"))
    assert joins.attach_scalar(spark.range(1), empty).first()["total"] is None


def test_a_metric_store_kept_by_retraction_equals_a_rebuild(spark, tables, tmp_path):
    """Segments come, change band and go, in several refreshes, one sent twice; only changed rows are given."""
    now = tables.position
    table = metrics.metrics_table(spark, f"{tmp_path}/kept")
    band = F.col("conv_band")
    none, old = now.limit(0), now.where(band == "sliding").withColumn("conv_band", F.lit("watch")).withColumn("conversion_rate", F.lit(0.5))
    gone = now.where(band == "healthy").withColumn("region", F.lit("nowhere"))
    metrics.refresh_metrics(table, none, old.unionByName(gone), 0)
    metrics.refresh_metrics(table, old, now.where(band == "sliding"), 1)
    metrics.refresh_metrics(table, gone, none, 2)
    for _ in range(2):
        metrics.refresh_metrics(table, none, now.where(band != "sliding"), 3)
    kept, built = metrics.stored_metrics(table), metrics.materialize_metrics(now)
    rounded = lambda df: sorted(
        tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.fillna(0, metrics.SUMS).select(metrics.STORED.names).collect()
    )
    assert rounded(kept) == rounded(built)


def test_notes_go_to_every_task_only_while_they_are_few(spark, segments, snapshots, tmp_path, monkeypatch):
    silver.note_slide_flags(snapshots).write.parquet(f"{tmp_path}/notes")
    notes = spark.read.parquet(f"{tmp_path}/notes")
    few = silver.silver_conv(snapshots, segments, notes)
    monkeypatch.setattr(silver, "BROADCAST_LIMIT_BYTES", 1)
    many = silver.silver_conv(snapshots, segments, notes)
    texts = [df._jdf.queryExecution().analyzed().toString() for df in (few, many)]
    assert "strategy=broadcast" in texts[0] and "strategy=broadcast" not in texts[1]
    assert sorted(map(str, few.select(sorted(few.columns)).collect())) == sorted(map(str, many.select(sorted(few.columns)).collect()))
