import datetime
import random

import pytest
from pyspark.sql import functions as F

from slidewatch.operators import decisions as D
from slidewatch.operators import silver

# Accepted moves of the decision life cycle (from, action).
MOVES = {
    ("none", "investigating"), ("none", "proposed"), ("investigating", "investigation_failed"), ("investigating", "proposed"),
    ("investigation_failed", "investigating"), ("investigation_failed", "proposed"), ("proposed", "redrafted"),
    ("proposed", "approved"), ("approved", "committed"),
}


def check_move(status, approver, action, by, pct):
    """(status, approver, reason) after an event; ``reason`` is None when it is accepted."""
    if (status, action) not in MOVES:
        return status, approver, "invalid transition"
    if action == "redrafted":
        return status, approver, None
    if action == "approved":
        if pct is None or not 1 <= pct <= 100:
            return status, approver, "rollout_pct must be between 1 and 100"
        return "approved", by, None
    if action == "committed" and approver is None:
        return status, approver, "an approver is required before commit"
    return action, approver, None


EVENTS = (
    "decision_id string, segment_id string, at timestamp_ntz, event_id bigint, by string, action string, notes string, "
    "tool string, assist_run_id string, rollout_pct int, action_type string, target_experiment_id string, "
    "flag_key string, variant string, drafted_note string, predicted_conversion_lift double"
)
T0 = datetime.datetime(2024, 1, 1)


def event(i, action, decision="d1", by="ana", pct=50, minutes=None, note=None):
    at = T0 + datetime.timedelta(minutes=i if minutes is None else minutes)
    return (
        decision, f"SEG-{decision}", at, i, by, action, "", "tool", f"run-{i}", pct, "ship_proven_variant", "EXP-1", "flow",
        "variant_a", note or f"note {i}", 0.01,
    )


def log(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def verdicts(spark, rows):
    return [(r["valid"], r["reason"]) for r in D.validate_transitions(log(spark, rows)).orderBy("at", "event_id").collect()]


def test_the_life_cycle(spark):
    rows = [event(i, a) for i, a in enumerate(["investigating", "investigation_failed", "investigating", "proposed", "redrafted", "approved", "committed"])]
    assert verdicts(spark, rows) == [(True, None)] * 7


def test_commit_needs_approval(spark):
    bad = (False, "invalid transition")
    assert verdicts(spark, [event(0, "proposed"), event(1, "committed"), event(2, "approved"), event(3, "committed"), event(4, "approved")]) == [
        (True, None), bad, (True, None), (True, None), bad,
    ]


def test_commit_needs_an_approver(spark):
    rows = [event(0, "proposed"), event(1, "approved", by=None), event(2, "committed"), event(3, "approved", by="ana"), event(4, "committed")]
    missing = (False, "an approver is required before commit")
    assert verdicts(spark, rows) == [(True, None), (True, None), missing, (False, "invalid transition"), missing]


@pytest.mark.parametrize(("pct", "ok"), [(1, True), (50, True), (100, True), (0, False), (101, False), (None, False)])
def test_rollout_range(spark, pct, ok):
    got = verdicts(spark, [event(0, "proposed"), event(1, "approved", pct=pct)])[1]
    assert got == ((True, None) if ok else (False, "rollout_pct must be between 1 and 100"))


def random_log(seed, n=2500, hot=True):
    rng = random.Random(seed)
    actions = ["investigating", "investigation_failed", "proposed", "redrafted", "approved", "committed"]
    weights = [6, 6, 1, 2, 2, 2]
    rows = []
    for i in range(n):
        decision = "hot" if hot and i % 3 == 0 else f"d{rng.randrange(400)}"
        action = rng.choices(actions, weights)[0]
        if decision == "hot" and i < n * 0.8 and action == "proposed":
            action = "investigating"
        by = rng.choice(["ana", "bo", None])
        rows.append(event(i, action, decision, by, rng.randrange(0, 110), minutes=rng.randrange(6000)))
    return rows


def expected(rows):
    out, state = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        status, approver = state.get(r[0], ("none", None))
        status, approver, reason = check_move(status, approver, r[5], r[4], r[9])
        state[r[0]] = (status, approver)
        out[r[3]] = (reason is None, reason)
    return out, state


@pytest.mark.parametrize("seed", [3, 4])
def test_every_verdict_equals_a_step_by_step_walk(spark, seed):
    rows = random_log(seed)
    want, state = expected(rows)
    checked = D.validate_transitions(log(spark, rows))
    got = {r["event_id"]: (r["valid"], r["reason"]) for r in checked.collect()}
    assert got == want
    walked, statuses = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        walked[r[0]] = check_move(*walked.get(r[0], ("none", None))[:2], r[5], r[4], r[9])
        statuses[r[3]] = walked[r[0]][0]
    assert {r["event_id"]: r["status"] for r in D.life_cycle(log(spark, rows)).collect()} == statuses
    valid = checked.where("valid").drop("valid", "reason")
    folded = {r["decision_id"]: (r["status"], r["approved_by"]) for r in D.fold_decisions(valid).collect()}
    assert folded == {k: v for k, v in state.items() if v[0] != "none"}


def test_fold_takes_each_value_from_its_event(spark):
    rows = [event(0, "investigating"), event(1, "proposed", note="first"), event(2, "redrafted", note="second"), event(3, "approved", pct=25), event(4, "committed")]
    row = D.fold_decisions(log(spark, rows)).first()
    assert (row["status"], row["drafted_note"], row["rollout_pct"], row["approved_by"]) == ("committed", "second", 25, "ana")
    assert (row["created_at"], row["decided_at"]) == (T0, T0 + datetime.timedelta(minutes=4))
    assert D.fold_decisions(log(spark, rows[:1])).first()["rollout_pct"] == 100
    assert D.fold_decisions(log(spark, rows[1:2])).first()["rollout_pct"] is None


def test_trail_pages_hold_every_entry_in_order(spark):
    rows = [event(i, "investigating" if i % 2 == 0 else "investigation_failed") for i in range(25)] + [event(90, "proposed")]
    trails = D.audit_trail(log(spark, rows), page_rows=10)
    pages = sorted(trails.collect(), key=lambda r: r["page"])
    assert [len(p["audit_trail"]) for p in pages] == [10, 10, 6]
    entries = [e for p in pages for e in p["audit_trail"]]
    assert [e["at"] for e in entries] == sorted(r[2] for r in rows)
    assert D.assist_run(trails).first()["assist_run_id"] == "run-90"
    feed = D.activity(trails, 3).collect()
    assert [r["what"] for r in feed] == ["proposed", "investigating", "investigation_failed"]


def test_redrafts_only_while_proposed(spark):
    rows = [event(0, "proposed", "a"), event(1, "proposed", "b"), event(2, "approved", "b")]
    decisions = D.fold_decisions(log(spark, rows))
    redrafts = spark.createDataFrame(
        [("a", T0, "old", "r1"), ("a", T0 + datetime.timedelta(1), "new", "r2"), ("b", T0, "late", "r3"), ("zz", T0, "none", "r4")],
        "decision_id string, at timestamp_ntz, drafted_note string, assist_run_id string",
    )
    applied, entries, refused = D.apply_redrafts(decisions, redrafts)
    assert {r["decision_id"]: r["drafted_note"] for r in applied.collect()} == {"a": "new", "b": "note 1"}
    trail = D.extend_trail(D.audit_entries(log(spark, rows)), entries).where("decision_id = 'a'").orderBy("position").collect()
    assert [(r["position"], r["action"], r["notes"]) for r in trail if r["action"] == "redrafted"] == [
        (r["position"], "redrafted", n) for r, n in zip([x for x in trail if x["action"] == "redrafted"], ["old", "new"])
    ]
    assert len(trail) == 3 and [r["position"] for r in trail] == [1, 2, 3]
    assert sorted(r["assist_run_id"] for r in refused.collect()) == ["r3", "r4"]


def open_frames(spark, n=60):
    rows = [(f"SEG-{i:07d}", 1000.0 * (i // 2), f"flag-{i}", i % 2 == 0) for i in range(n)]
    open_rows = spark.createDataFrame(rows, "segment_id string, conversion_at_risk_usd double, neighbor_flag_key string, has_matching_experiment boolean")
    open_rows = open_rows.withColumns({"matching_experiment_id": F.lit(None).cast("string"), "matching_experiment_lift": F.lit(0.01)})
    positions = open_rows.select("segment_id", "conversion_at_risk_usd", F.lit("sliding").alias("conv_band"), F.lit(5).alias("sessions"))
    recs = open_rows.where("has_matching_experiment").select(
        "segment_id", F.lit("rollout_existing_flag").alias("recommended_action"), F.lit(0.02).alias("predicted_conversion_lift")
    )
    return positions, open_rows, recs


def test_live_view_ranks_all_and_shows_the_latest_decision(spark):
    positions, open_rows, recs = open_frames(spark)
    rows = [event(0, "proposed", "x"), event(1, "proposed", "y", minutes=30)]
    decisions = D.fold_decisions(log(spark, rows)).withColumn("segment_id", F.lit("SEG-0000058"))
    view = D.live_view(positions, open_rows, recs, decisions).collect()
    assert len(view) == 40 and [r["risk_rank"] for r in view] == list(range(1, 41))
    assert [r["segment_id"] for r in view[:3]] == ["SEG-0000058", "SEG-0000059", "SEG-0000056"]
    assert view[0]["decision_id"] == "y" and view[1]["decision_id"] is None and view[1]["recommended_action"] is None
    one = D.live_view(positions, open_rows, recs, decisions, "SEG-0000000", 1).collect()
    assert D.live_view(positions, open_rows, recs, decisions, limit=55).count() == 55
    with pytest.raises(ValueError):
        D.live_view(positions, open_rows, recs, decisions, limit=0)
    assert [r["decision_id"] for r in D.cases(open_rows, decisions).collect()] == ["y"]
    assert [(r["segment_id"], r["risk_rank"]) for r in one] == [("SEG-0000000", 59)]
    assert D.live_view(positions, open_rows, recs, decisions, limit=None).count() == 60
    nxt = D.next_cases(open_rows, recs, decisions, 2).orderBy("segment_id").collect()
    assert [(r["segment_id"], r["action_type"]) for r in nxt] == [("SEG-0000056", "rollout_existing_flag"), ("SEG-0000059", "ship_proven_variant")]


def test_kpis_fall_when_a_segment_ships(spark):
    positions, _, _ = open_frames(spark)
    rows = [event(0, "proposed", "x"), event(1, "approved", "x"), event(2, "committed", "x")]
    decisions = D.fold_decisions(log(spark, rows)).withColumn("segment_id", F.lit("SEG-0000058"))
    row = D.kpi_after_decisions(positions, decisions).first()
    assert row["sliding_before"] - row["sliding_after"] == 1
    assert row["at_risk_before"] - row["at_risk_after"] == 29000.0


def test_reset_and_rules(spark):
    decisions = D.fold_decisions(log(spark, [event(0, "proposed", "a"), event(1, "proposed", "b")]))
    kept, deleted = D.reset_decisions(decisions, "SEG-a")
    assert [r["decision_id"] for r in kept.collect()] == ["b"] and deleted.first()["deleted_count"] == 1
    kept, deleted = D.reset_decisions(decisions)
    assert kept.count() == 0 and deleted.first()["deleted_count"] == 2
    bad = decisions.withColumn("status", F.lit("shipped")).withColumn("rollout_pct", F.lit(101))
    _, counted = silver.expect(bad, D.decision_rules(), "warn")
    failed = {r["rule"]: r["failed"] for r in counted.collect()}
    assert failed["status"] == 2 and failed["rollout_pct"] == 2 and failed["action_type"] == 0
