"""Plan shapes that must hold at any size."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from slidewatch.operators import commerce, gold, metrics, rank, silver
from slidewatch.operators import decisions as D
from slidewatch.plans.queries import QUERIES as REGISTERED
from tests.conftest import SMALL
from tests.test_skew import settings

BATCH = [n for n in REGISTERED if not n.startswith(("stream_", "model_", "learned_"))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pairwise_joins_and_no_python_rows(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert word not in text, word


def test_set_filters_reach_the_scan(tables):
    text = plan(metrics.slice_rows(tables.position, platform="android", band="watch").select("segment_id"))
    assert "EqualTo(platform,android)" in text and "EqualTo(conv_band,watch)" in text
    assert "cohort" not in text.split("ReadSchema")[1]


def test_date_ranges_reach_the_scan(tables):
    text = plan(gold.segment_position(tables.conv, tables.daily, "2024-01-30"))
    assert "GreaterThan(snapshot_date" in text and "LessThanOrEqual(event_date" in text


def test_events_are_read_by_column_and_summed_before_the_join(tables):
    text = plan(silver.silver_events(tables.events, tables.segments))
    scan = next(line for line in text.splitlines() if "events.parquet" in line)
    assert "props" not in scan.split("ReadSchema")[1]
    assert text.index("Join") < text.index("partial_count")  # the partial sum lies below the join


def test_latest_row_combines_before_the_shuffle(tables):
    text = plan(rank.latest_per_key(tables.orders, "customer_id", ["order_date", "order_id"]))
    assert "partial_max_by" in text and "Window" not in text


def test_top_rows_per_group_are_cut_before_the_shuffle(tables):
    text = plan(commerce.facility_lots(tables.returns(product=True, place=True)))
    assert "WindowGroupLimit" in text


def test_the_ranking_window_without_a_key_sees_one_row_per_range(tables):
    text = plan(rank.risk_rank(tables.open_rows))
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert len(windows) == 1 and "_rows" in windows[0] and "_range" in windows[0]


def test_actions_are_made_without_a_shuffle(tables):
    text = plan(gold.with_net_value(gold.action_candidates(tables.open_rows)))
    assert "Exchange" not in text and "Join" not in text


def test_next_case_is_an_anti_join_and_a_bounded_sort(tables):
    text = plan(D.next_cases(tables.open_rows, tables.recs, tables.decisions, 1))
    assert "LeftAnti" in text and "TakeOrderedAndProject" in text


def test_bm25_shuffles_counts_and_not_texts(spark, tables):
    from slidewatch.operators import search
    from slidewatch import session

    kept, session.SCAN_SPLIT_BYTES = session.SCAN_SPLIT_BYTES, 0
    try:
        df = search.bm25_search(tables.raw("documents"), "that there will be a checkout", 5, "doc_id", "text")
        df.collect()
        text = plan(df).split("== Initial Plan")[0]
    finally:
        session.SCAN_SPLIT_BYTES = kept
    exchange = text.index("Exchange hashpartitioning(doc_id")
    assert "ReusedExchange" in plan(df)
    assert "regexp_extract_all" in text[exchange:] or "ReusedExchange" in text  # words are cut below the shuffle


def test_no_plan_depends_on_a_forced_broadcast_of_segments(tables):
    logical = gold.open_sliding(tables.position, tables.experiments, tables.silver_flags, tables.segments)
    text = logical._jdf.queryExecution().analyzed().toString()
    # Only the two lookups by cohort and platform are hinted, and those are aggregates.
    hinted = [after.split("Aggregate [")[1][:30] for after in text.split("strategy=broadcast")[1:]]
    assert len(hinted) == 2 and all(h.startswith(("tested_cohort", "platform")) for h in hinted), hinted


def test_written_tables_are_written_once(spark, tables):
    from slidewatch.plans.sample_data import Tables

    again = Tables(spark, SMALL)
    assert again.position.inputFiles() == tables.position.inputFiles()
    assert tables.position.agg(F.count(F.lit(1))).first()[0] > 0


def test_transitions_read_the_events_twice_and_shuffle_them_twice(spark, tables):
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        checked = D.validate_transitions(tables.decision_events)
        checked.collect()
        ran = checked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert ran.count("FileScan") <= 2
    # Two of them carry events; the others one row per decision and slice.
    assert ran.count("Exchange hashpartitioning") <= 4


@pytest.mark.parametrize("name", ["change_history", "audit_trails", "running_costs", "budget_states"])
def test_ordered_scans_read_their_input_once(spark, name):
    """Window and slices share one shuffle of the input: one scan, and the other use of the shuffle is a reuse."""
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        df = entry.queries()[name](spark, SMALL)
        df.collect()
        final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") >= 1


def test_flags_are_dealt_by_size_before_a_task_sorts_them(spark, tables):
    text = plan(silver.silver_flags(tables.flags))
    partial, dealt = text.index("partial_min_by"), text.index("REBALANCE_PARTITIONS_BY_COL")
    assert partial < dealt and text.index("Generate") > dealt  # an operator stands above what it reads
    assert text.index("REBALANCE_PARTITIONS_BY_COL", dealt + 1) > text.index("Generate")  # segments, before flags are made of them
    rows = [("S", "a", f"F{k % 7}", f"2024-01-{k % 9 + 1:02d}") for k in range(500)] + [(None, "a", "F1", None), ("S", None, None, "2024-01-02")]
    flags = spark.createDataFrame(rows, "segment_id string, feature_area string, flag_id string, day string").coalesce(1)
    found = silver.silver_flags(flags.selectExpr("segment_id", "feature_area", "flag_id", "to_date(day) AS updated_date")).collect()
    got = {(r["segment_id"], r["feature_area"]): (r["flag_id"], str(r["updated_date"])) for r in found}
    assert got == {("S", "a"): ("F0", "2024-01-09"), (None, "a"): ("F1", "None"), ("S", None): (None, "2024-01-02")}
