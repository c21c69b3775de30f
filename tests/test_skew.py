"""A third of all rows on one key."""

import contextlib
from collections import Counter

from pyspark.sql import functions as F

from slidewatch.operators import decisions as D
from slidewatch.operators import cdc, silver, usage
from tests.test_decisions import expected, log, random_log


@contextlib.contextmanager
def settings(spark, **values):
    values = {f"spark.sql.{k.replace('_', '.')}": v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def biggest_share(df):
    """Share of the rows that end up in the fullest partition. All columns are kept, so that no step is pruned."""
    counts = Counter(r["_partition"] for r in df.withColumn("_partition", F.spark_partition_id()).collect())
    return max(counts.values()) / sum(counts.values())


def test_a_hot_decision_is_judged_right_and_spread(spark):
    rows = random_log(11, n=6000)
    events = log(spark, rows).repartition(8)
    checked = D.validate_transitions(events)
    assert {r["event_id"]: (r["valid"], r["reason"]) for r in checked.collect()} == expected(rows)[0]
    with settings(spark, shuffle_partitions="16", adaptive_coalescePartitions_enabled="false", autoBroadcastJoinThreshold="-1"):
        assert biggest_share(events.repartition("decision_id")) > 0.33
        assert biggest_share(D.validate_transitions(events)) < 0.2
        assert biggest_share(D.audit_entries(events)) < 0.2


def test_a_hot_key_of_changes_is_spread(spark):
    from tests.test_streaming import change_rows

    changes = change_rows(spark, n=3000)
    with settings(spark, shuffle_partitions="16", adaptive_coalescePartitions_enabled="false", autoBroadcastJoinThreshold="-1"):
        assert biggest_share(changes.repartition("k")) > 0.33
        assert biggest_share(cdc.scd2(changes, "k", F.floor(F.col("_pg_lsn") / 50))) < 0.2


def test_a_hot_requester_is_summed_by_slices(spark):
    n = 30000
    requests = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("id") % 997).cast("string"))).alias("requester"),
        F.timestamp_micros(F.col("id") * 60000000).cast("timestamp_ntz").alias("event_time"),
        F.col("id").alias("request_id"), F.lit("0.0000010000").cast("decimal(28,10)").alias("est_cost_usd"),
    )
    total = usage.running_cost(requests).where("requester = 'hot'").agg(F.max("running_cost_usd"), F.count("*")).first()
    assert float(total[0]) == 0.01 and total[1] == 10000
    state = usage.budget_state(requests, 0.005, 0.01).where("requester = 'hot'").first()
    assert (state["state"], state["alert_request_id"], state["blocked_request_id"]) == ("blocked", 4999 * 3, 9999 * 3)


def test_a_hot_segment_joins_as_one_row_a_day(spark, tables):
    events = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, F.lit("SEG-0000001")).otherwise(F.format_string("SEG-%07d", F.col("id") % 150 + 1)).alias("segment_id"),
        F.lit("2024-01-01").cast("date").alias("event_date"), F.lit(True).alias("converted"), F.lit(1.0).alias("revenue_usd"),
    )
    out = silver.silver_events(events, tables.segments)
    assert out.agg(F.sum("sessions")).first()[0] == 20000 and out.count() == 101
