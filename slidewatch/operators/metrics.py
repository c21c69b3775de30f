"""Conversion metrics: one dictionary of measures over any subset of the dimensions, and the dashboard queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidewatch.functions.schema import struct
from slidewatch.functions.exprs import count_if, percentage
from slidewatch.streaming.keyed import KeyedTable, summed

DIMENSIONS = ["cohort", "platform", "conv_band", "region", "segment_id"]
MATERIALIZED_DIMS = ["cohort", "platform", "conv_band", "region"]


def measures() -> dict[str, Column]:
    return {
        "conversion_at_risk": F.round(F.sum("conversion_at_risk_usd"), 4),
        "total_mau": F.sum(F.col("mau").cast("long")),
        "avg_conversion": F.avg("conversion_rate"),
        "segment_count": F.count(F.lit(1)),
        "sliding_count": count_if(F.col("conv_band") == "sliding"),
        "watch_count": count_if(F.col("conv_band") == "watch"),
        "atrisk_count": count_if(F.col("conv_band").isin("sliding", "watch")),
        "avg_slide_signal": F.avg("slide_signal_score"),
    }


def slice_rows(
    df: DataFrame, cohort: str | None = None, platform: str | None = None, band: str | None = None
) -> DataFrame:
    """Optional filters. A filter that is not set is not in the plan, so the set ones still reach the scan."""
    for column, value in (("cohort", cohort), ("platform", platform), ("conv_band", band)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def segment_metrics(
    positions: DataFrame,
    dims: Sequence[str] = (),
    filters: Mapping[str, str] | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    unknown = [d for d in dims if d not in DIMENSIONS]
    if unknown:
        raise ValueError(f"not a dimension: {unknown}")
    for column, value in (filters or {}).items():
        positions = positions.where(F.col(column) == value)
    chosen = measures()
    return positions.groupBy(*dims).agg(*[chosen[n].alias(n) for n in (names or chosen)])


def materialize_metrics(positions: DataFrame) -> DataFrame:
    """Stored at the declared grain as sums and counts, so that every coarser grain can be derived from it."""
    return positions.groupBy(*MATERIALIZED_DIMS).agg(
        F.sum("conversion_at_risk_usd").alias("at_risk_sum"),
        F.sum(F.col("mau").cast("long")).alias("mau_sum"),
        F.sum("conversion_rate").alias("rate_sum"),
        F.count("conversion_rate").alias("rate_count"),
        F.sum("slide_signal_score").alias("signal_sum"),
        F.count("slide_signal_score").alias("signal_count"),
        F.count(F.lit(1)).alias("segment_count"),
    )


STORED = struct(
    cohort="string", platform="string", conv_band="string", region="string", at_risk_sum="double", mau_sum="long", rate_sum="double",
    rate_count="long", signal_sum="double", signal_count="long", segment_count="long",
)
SUMS = [c for c in STORED.names if c not in MATERIALIZED_DIMS]


def metrics_table(spark: SparkSession, path: str, buckets: int = 1) -> KeyedTable:
    """The stored aggregate as a table that is kept up to date by sums."""
    return KeyedTable(spark, path, STORED, MATERIALIZED_DIMS, summed(MATERIALIZED_DIMS, SUMS), buckets=buckets)


def refresh_metrics(table: KeyedTable, before: DataFrame, after: DataFrame, number: int) -> None:
    """Takes changed segments out of the stored sums as they were and puts them in as they are.

    ``before`` and ``after`` are the position rows of the changed segments only; a new segment has no row before, a deleted
    one none after. Refresh ``number`` counts once, however often it is sent.
    """
    out = materialize_metrics(before).select(*MATERIALIZED_DIMS, *[(-F.col(c)).alias(c) for c in SUMS])
    table.merge(out.unionByName(materialize_metrics(after)), number)


def stored_metrics(table: KeyedTable) -> DataFrame:
    """Groups that have segments; sums of none are 0."""
    return table.read().where("segment_count > 0").fillna(0, SUMS).drop("_version")


def store_metrics(positions: DataFrame, path: str) -> DataFrame:
    """Writes the stored aggregate and reads it back; a refresh overwrites it as a whole."""
    materialize_metrics(positions).write.mode("overwrite").parquet(path)
    return positions.sparkSession.read.parquet(path)


def rollup_from(stored: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """The eight measures at a coarser grain, from the stored aggregate only."""

    def only(*bands: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("conv_band").isin(*bands), F.col("segment_count"))), F.lit(0)).cast("long")

    return stored.groupBy(*dims).agg(
        F.round(F.sum("at_risk_sum"), 4).alias("conversion_at_risk"),
        F.sum("mau_sum").alias("total_mau"),
        (F.sum("rate_sum") / F.when(F.sum("rate_count") > 0, F.sum("rate_count"))).alias("avg_conversion"),
        F.sum("segment_count").alias("segment_count"),
        only("sliding").alias("sliding_count"),
        only("watch").alias("watch_count"),
        only("sliding", "watch").alias("atrisk_count"),
        (F.sum("signal_sum") / F.when(F.sum("signal_count") > 0, F.sum("signal_count"))).alias("avg_slide_signal"),
    )


def dashboard_conv(positions: DataFrame) -> DataFrame:
    return positions.sparkSession.sql(
        """
        SELECT cohort, platform, conv_band, region,
               round(sum(conversion_at_risk_usd), 4) AS conversion_at_risk_usd,
               sum(CAST(mau AS BIGINT)) AS total_mau,
               avg(conversion_rate) AS avg_conversion,
               count_if(conv_band = 'sliding') AS sliding_count,
               count_if(conv_band IN ('sliding', 'watch')) AS atrisk_count,
               count(1) AS segment_count
        FROM {positions}
        GROUP BY ALL
        """,
        positions=positions,
    )


def kpis(positions: DataFrame) -> DataFrame:
    """One row: value at risk, sliding count, users at risk, mean rate of healthy and sliding segments, gap."""
    band = F.col("conv_band")
    row = positions.agg(
        F.round(F.sum("conversion_at_risk_usd"), 4).alias("conversion_at_risk_usd"),
        count_if(band == "sliding").alias("sliding_segments"),
        F.coalesce(F.sum(F.when(band.isin("sliding", "watch"), F.col("mau").cast("long"))), F.lit(0)).alias("mau_at_risk"),
        F.avg(F.when(band == "healthy", F.col("conversion_rate"))).alias("avg_conversion_healthy"),
        F.avg(F.when(band == "sliding", F.col("conversion_rate"))).alias("avg_conversion_sliding"),
    )
    return row.withColumn("conversion_gap", F.col("avg_conversion_healthy") - F.col("avg_conversion_sliding"))


def slide_mix_by_platform(positions: DataFrame) -> DataFrame:
    return positions.groupBy("platform", "conv_band").agg(F.count(F.lit(1)).alias("segments"))


def slide_mix_pivot(positions: DataFrame) -> DataFrame:
    """The same counts with one column per band; the bands are given, so no extra pass looks for them."""
    return (
        positions.groupBy("platform").pivot("conv_band", ["sliding", "watch", "healthy"]).agg(F.count(F.lit(1)))
        .na.fill(0, ["sliding", "watch", "healthy"])
    )


def at_risk_by_cohort(positions: DataFrame) -> DataFrame:
    return positions.groupBy("cohort").agg(F.round(F.sum("conversion_at_risk_usd"), 4).alias("conversion_at_risk_usd"))


def sliding_profile(positions: DataFrame) -> DataFrame:
    return positions.groupBy("cohort", "platform", "conv_band").agg(F.count(F.lit(1)).alias("segments"))


def conversion_trend(conv: DataFrame, positions: DataFrame, grain: str = "week", as_of: str | None = None, weeks: int = 8) -> DataFrame:
    """Mean snapshot rate per day or week of sliding segments and of the rest."""
    if as_of is not None:
        day = F.lit(as_of).cast("date")
        conv = conv.where((F.col("snapshot_date") <= day) & (F.col("snapshot_date") > F.date_sub(day, 7 * weeks)))
    group = F.when(F.col("conv_band") == "sliding", F.lit("sliding")).otherwise(F.lit("rest")).alias("segment_group")
    labels = positions.select("segment_id", group)
    return (
        conv.join(labels, "segment_id")
        .groupBy(F.to_date(F.date_trunc(grain, F.col("snapshot_date").cast("timestamp_ntz"))).alias("period"), "segment_group")
        .agg(F.avg("conversion_rate").alias("avg_conversion"), F.count(F.lit(1)).alias("snapshots"))
    )


def segment_trend(events: DataFrame, segment_id: str, as_of: str, days: int = 21) -> DataFrame:
    """Daily series of one segment (at most one row per day of the range)."""
    day = F.lit(as_of).cast("date")
    return (
        events.where(
            (F.col("segment_id") == segment_id)
            & (F.col("event_date") <= day)
            & (F.col("event_date") > F.date_sub(day, days))
        )
        .select("segment_id", "event_date", "sessions", "conversions", "conversion_rate")
        .orderBy("event_date")
    )


def scatter_points(positions: DataFrame, number: Column, percent: int = 30) -> DataFrame:
    """All segments that are not healthy and a repeatable share of the healthy ones, by a hash of ``number``."""
    kept = F.pmod(number, F.lit(100)) < percent
    return positions.where((F.col("conv_band") != "healthy") | kept).select(
        "segment_id", "cohort", "platform", "mau", "conversion_rate", "conversion_drop", "conv_band"
    )


def mode_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; equal counts go to the smallest value."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))
    return counts.groupBy(key).agg(F.min(best).alias("best")).select(key, F.col("best.v").alias(value))


def first_after_agg(df: DataFrame, key: str, value: str) -> DataFrame:
    """The same by a window over the aggregate: rows per key are distinct values, not input rows."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col(value).asc())
    return counts.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(key, value, "n")


def conversion_share(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    grouped = df.groupBy(*dims).agg(
        F.sum("conversions").cast("long").alias("conversions"), F.sum("sessions").cast("long").alias("sessions")
    )
    return grouped.withColumn("conversion_pct", percentage("conversions", "sessions", 3))


def dedup_ratio(df: DataFrame, column: str) -> DataFrame:
    """Distinct values against rows. Distinct values are found by a grouped count, so no set is held in one task."""
    per_value = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(
        F.count(column).alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col(column).isNotNull(), F.col("n"))), F.lit(0)).alias("non_null_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("all_rows"),
    )
