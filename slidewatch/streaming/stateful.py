"""Stateful streams: the decision life cycle and running budgets, with the state in keyed tables.

A micro-batch meets the state that the batches before it left, as rows: the moves that lead to a decision's stored status,
or a requester's stored total. Batch operators do the rest, so no row passes through Python, a hot key is cut into time
slices, and a batch that comes again gives what it gave before. Batches apply in the order of their arrival; inside
a batch the order of events counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidewatch.functions.scan import join_by_slice, running_total
from slidewatch.functions.schema import struct
from slidewatch.operators.decisions import life_cycle
from slidewatch.streaming.keyed import KeyedTable, each_batch, summed

DECISION_OUTPUT = struct(
    decision_id="string", event_id="long", action="string", valid="boolean", status="string", reason="string"
)
BUDGET_OUTPUT = struct(
    requester="string", request_id="long", event_time="timestamp", limit_name="string", running_units="long"
)
DECISION_STATE = struct(decision_id="string", status="string", approver="string", last_at="timestamp")
SPENT = struct(requester="string", epoch="timestamp", units="long")
COST_UNITS = 10**10  # budgets are kept in units of 1e-10 US dollars, so sums are exact

#: The shortest accepted moves that lead to each status.
_LEADS = {
    "investigating": ["investigating"],
    "investigation_failed": ["investigating", "investigation_failed"],
    "proposed": ["proposed"],
    "approved": ["proposed", "approved"],
    "committed": ["proposed", "approved", "committed"],
}
#: Stored moves stand before all events.
_BEFORE = "0001-01-01 00:00:00"


def decision_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    """Status, approver and time of the last event of every decision that is not forgotten."""
    return KeyedTable(spark, f"{path}-states", DECISION_STATE, ["decision_id"], buckets=buckets)


def _led(states: DataFrame, at_type: str) -> DataFrame:
    """The stored states as events: the moves that lead to each."""
    moves = F.create_map(*[x for status, lead in _LEADS.items() for x in (F.lit(status), F.array(*map(F.lit, lead)))])
    rows = states.select("decision_id", "approver", F.posexplode(moves[F.col("status")]).alias("place", "action"))
    approved = F.col("action") == "approved"
    return rows.select(
        "decision_id", F.lit(_BEFORE).cast(at_type).alias("at"), F.col("place").cast("long").alias("event_id"), "action",
        F.when(approved, F.col("approver")).alias("by"), F.when(approved, F.lit(100)).alias("rollout_pct"), F.lit(True).alias("stored"),
    )


def stream_decisions(events: DataFrame, path: str, checkpoint: str, keep_days: int = 365, buckets: int = 16, slice_unit: str = "hour") -> None:
    """Writes every event with its verdict and the status after it to ``path``, a folder per batch.

    A committed decision is forgotten when its last event lies ``keep_days`` before the newest event of a batch; an event
    that comes for it later opens it anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table = decision_table(batch.sparkSession, path, buckets)
        done = table.version()
        if done is not None and batch_id <= done:
            return
        at_type = batch.schema["at"].dataType.simpleString()
        new = batch.select(
            "decision_id", "at", F.col("event_id").cast("long"), "action", "by", F.col("rollout_pct").cast("int"), F.lit(False).alias("stored")
        ).persist()
        newest = new.agg(F.max("at").cast("timestamp")).first()[0]
        kept = F.lit(True) if newest is None else ~(
            (F.col("status") == "committed") & (F.col("last_at") < F.lit(newest) - F.expr(f"INTERVAL {int(keep_days)} DAYS"))
        )
        known = table.read(table.buckets_of(new)).where(kept).join(new.select("decision_id").distinct(), "decision_id", "left_semi")
        judged = life_cycle(new.unionByName(_led(known, at_type)), slice_unit).persist()
        judged.where(~F.col("stored")).select(*DECISION_OUTPUT.names).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        moment = F.struct("at", "event_id")
        approver = F.max_by("by", F.when(F.col("valid") & (F.col("action") == "approved"), moment))
        states = judged.groupBy("decision_id").agg(
            F.max_by("status", moment).alias("status"), approver.alias("approver"), F.max("at").cast("timestamp").alias("last_at")
        )
        table.merge(states, batch_id, kept)
        judged.unpersist()
        new.unpersist()

    each_batch(events, write, checkpoint)


def spent_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    """Cost per requester and time slice."""
    keys = ["requester", "epoch"]
    return KeyedTable(spark, f"{path}-spent", SPENT, keys, summed(keys, ["units"]), bucket_by=["requester"], buckets=buckets)


def stream_budget_alerts(
    usage: DataFrame, limits: dict[str, float], path: str, checkpoint: str, buckets: int = 16, slice_unit: str = "hour",
) -> None:
    """Writes one row per requester and limit to ``path``, when the running cost first reaches it.

    Stored are sums per requester and time slice. A batch starts from a requester's stored total and adds up its own rows, slice
    by slice; a limit that the stored total had reached was reported before.
    """
    units = {name: round(value * COST_UNITS) for name, value in limits.items()}

    def write(batch: DataFrame, batch_id: int) -> None:
        table = spent_table(batch.sparkSession, path, buckets)
        done = table.version()
        if done is not None and batch_id <= done:
            return
        new = batch.select(
            "requester", "request_id", "event_time", (F.col("est_cost_usd") * COST_UNITS).cast("long").alias("units")
        ).persist()
        epoch = F.date_trunc(slice_unit, "event_time")
        asked = new.select("requester").distinct()
        before = table.read(table.buckets_of(new)).join(asked, "requester", "left_semi").groupBy("requester").agg(F.sum("units").alias("_before"))
        running = running_total(new, ["requester"], ["event_time", "request_id"], F.col("units"), epoch, "_own")
        running = join_by_slice(running, before, ["requester"], epoch, "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
        after = F.col("_before") + F.col("_own")
        reached = running.groupBy("requester").agg(
            *[
                F.min(F.when((after >= limit) & (F.col("_before") < limit), F.struct("event_time", "request_id", after.alias("units")))).alias(name)
                for name, limit in units.items()
            ]
        )
        each = F.explode(F.array(*[F.struct(F.lit(name).alias("limit_name"), F.col(name).alias("at")) for name in units]))
        alerts = reached.select("requester", each.alias("alert")).where("alert.at IS NOT NULL")
        alerts.select(
            "requester", F.col("alert.at.request_id").cast("long").alias("request_id"), F.col("alert.at.event_time").cast("timestamp").alias("event_time"),
            "alert.limit_name", F.col("alert.at.units").cast("long").alias("running_units"),
        ).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        table.merge(new.groupBy("requester", epoch.cast("timestamp").alias("epoch")).agg(F.sum("units").alias("units")), batch_id)
        new.unpersist()

    each_batch(usage, write, checkpoint)
