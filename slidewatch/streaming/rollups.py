"""Windowed aggregations over streams. Event times are TIMESTAMP; watermarks do not accept TIMESTAMP_NTZ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidewatch.functions.schema import struct
from slidewatch.operators.silver import SEGMENT_DIMS
from slidewatch.streaming.keyed import each_batch
from slidewatch.streaming.log import batch_writer, read_latest


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None, names: str | None = None
) -> DataFrame:
    """Parquet files of a landing folder as they arrive; ``names`` is an optional file name pattern.

    A micro-batch takes at most the given number of files, or about 1 GB.
    """
    reader = spark.readStream.schema(schema)
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", 2**30)
    return reader.parquet(folder)


SILVER_SCHEMA = struct(segment_id="string", event_date="date", sessions="long", conversions="long", revenue="double")
ENRICHED_SCHEMA = struct(
    segment_id="string", event_date="date", sessions="long", conversions="long", revenue="double", conversion_rate="double",
    cohort="string", platform="string", region="string", known="boolean",
)


def stream_silver_events(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Daily rollup per segment over sessions with column ``event_time``."""
    daily = (
        events.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", "1 day"), "segment_id")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.sum(F.col("converted").cast("int")).cast("long").alias("conversions"),
            F.sum("revenue_usd").alias("revenue"),
        )
    )
    return daily.select("segment_id", F.to_date("window.start").alias("event_date"), "sessions", "conversions", "revenue")


def run_silver_events(daily: DataFrame, segments: Callable[[SparkSession], DataFrame], path: str, checkpoint: str) -> None:
    """Writes the streamed daily rollup with its rate and segment columns, a folder per batch.

    ``segments`` gives the segment table as it is now and is asked anew for every batch, so a batch joins the segments of its
    own time. A day of a segment that is not there yet is kept without its columns.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        dims = segments(batch.sparkSession).select("segment_id", *SEGMENT_DIMS, F.lit(True).alias("known"))
        rated = batch.withColumn("conversion_rate", F.col("conversions") / F.col("sessions"))
        rows = rated.join(dims, "segment_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        batch_writer(path)(rows.select(*ENRICHED_SCHEMA.names), batch_id)

    each_batch(daily, write, checkpoint, "update")


def read_silver_events(spark: SparkSession, path: str, segments: DataFrame) -> DataFrame:
    """The newest row of every segment and day; days that came before their segment get its columns here."""
    rows = read_latest(spark, path, ENRICHED_SCHEMA, ["segment_id", "event_date"])
    late = rows.where("NOT known").drop(*SEGMENT_DIMS).join(segments.select("segment_id", *SEGMENT_DIMS), "segment_id")
    return rows.where("known").unionByName(late).drop("known")


HOURLY_SCHEMA = struct(hour="timestamp", gateway="string", cost="cost", total_tokens="long", requests="long")


def stream_usage_hourly(base: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Hourly cost by gateway over ``usage_base`` rows with a TIMESTAMP ``event_time``."""
    hourly = (
        base.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", "1 hour"), "gateway")
        .agg(
            F.sum("est_cost_usd").alias("cost"),
            F.sum("total_tokens").alias("total_tokens"),
            F.count(F.lit(1)).alias("requests"),
        )
    )
    return hourly.select(F.col("window.start").alias("hour"), "gateway", "cost", "total_tokens", "requests")
