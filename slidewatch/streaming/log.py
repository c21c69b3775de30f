"""A batch log: each micro-batch is written to its own folder, so a replayed batch overwrites itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidewatch.operators.rank import latest_per_key
from slidewatch.sources.tables import read_optional


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Processes what is available and stops; a later call goes on from the checkpoint."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(batch_writer(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All written batches with their number in column ``batch``."""
    return read_optional(spark, path, T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))


def read_latest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The newest result of each key of an update-mode aggregation."""
    log = read_log(spark, path, schema).withColumn("_key", F.struct(*keys))
    return latest_per_key(log, "_key", ["batch"]).drop("_key", "batch")
