"""Keyed mirrors and change history from change streams, kept in tables that stay as small as their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidewatch.functions.scan import join_by_slice, next_row
from slidewatch.operators.cdc import CHANGE_ORDER, images
from slidewatch.operators.rank import latest_per_key
from slidewatch.streaming.keyed import KeyedTable, each_batch, newest

IMAGE = "_pg_change_type <> 'delete'"


def newest_changes(batch: DataFrame, key: str) -> DataFrame:
    """The last change of each key, deletes included."""
    return latest_per_key(images(batch), key, CHANGE_ORDER)


def mirror_table(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 16, most_runs: int = 4) -> KeyedTable:
    """A key's newest change. A deleted key keeps its delete, so that an older change that comes late does not bring it back."""
    return KeyedTable(spark, path, schema, [key], newest([key], CHANGE_ORDER), buckets=buckets, most_runs=most_runs)


def sync_changes(
    changes: DataFrame, key: str, path: str, checkpoint: str, buckets: int = 16, most_runs: int = 4, keep_deletes: int | None = None,
) -> None:
    """Keeps a mirror up to date from a change stream, whatever the order and repetition of its batches.

    ``keep_deletes``: how far, in log positions, a delete must lie behind the newest change of a batch to be forgotten when its
    bucket is folded; a change that comes later than that is taken for a new row. By default no delete is forgotten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table = mirror_table(batch.sparkSession, path, changes.schema, key, buckets, most_runs)
        keep = None
        if keep_deletes is not None:
            last = batch.agg(F.max("_pg_lsn")).first()[0]
            keep = F.expr(IMAGE) | (F.col("_pg_lsn") > F.lit(last) - keep_deletes) if last is not None else None
        table.merge(newest_changes(batch, key), batch_id, keep)

    each_batch(changes, write, checkpoint)


def read_mirror(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 16, most_runs: int = 4) -> DataFrame:
    """Current rows of the mirror."""
    return mirror_table(spark, path, schema, key, buckets, most_runs).read().where(IMAGE).select(*schema.names)


def compact_mirror(spark: SparkSession, path: str, schema: T.StructType, key: str, target: str) -> DataFrame:
    """Writes the current rows as one plain table for readers that know nothing of runs."""
    read_mirror(spark, path, schema, key).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


_NEXT = "_pg_next"


def history_table(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 16, most_runs: int = 4) -> KeyedTable:
    """One row per change, with the moment and time of the change that follows it."""
    follows = T.StructType([*[schema[c] for c in CHANGE_ORDER], schema["_timestamp"]])
    rows = T.StructType([*schema.fields, T.StructField(_NEXT, follows)])
    return KeyedTable(spark, path, rows, [key, *CHANGE_ORDER], bucket_by=[key], buckets=buckets, most_runs=most_runs)


def stream_cdc_history(
    changes: DataFrame, path: str, checkpoint: str, key: str, slice_by: Column | None = None, buckets: int = 16, most_runs: int = 4,
) -> None:
    """Keeps the version history up to date: each batch closes, splits and opens the intervals it touches.

    Of the stored changes of a key only those can change whose interval ends after the first new change: for a feed in order
    that is the open one, for a late change the one it splits. They are read from the touched buckets, put in order with
    the new ones, and only rows whose following change is another one are written. A change that was stored before is the same
    row again, so repeated deliveries change nothing, however late.
    """
    slice_by = F.floor(F.col("_pg_lsn") / 1000000) if slice_by is None else slice_by

    def write(batch: DataFrame, batch_id: int) -> None:
        table = history_table(batch.sparkSession, path, changes.schema, key, buckets, most_runs)
        new = images(batch).dropDuplicates([key, *CHANGE_ORDER]).persist()
        moment, follows = F.struct(*CHANGE_ORDER), F.struct(*[f"{_NEXT}.{c}" for c in CHANGE_ORDER])
        was = T.StructType([T.StructField("stored", T.BooleanType()), table.schema[_NEXT]])
        once = new.withColumn("_was", F.lit(None).cast(was))
        if table.version() is not None:
            first = new.groupBy(key).agg(F.min(moment).alias("_first"))
            stored = join_by_slice(table.read(table.buckets_of(new)).drop("_version"), first, [key], slice_by)
            affected = stored.where(F.col(_NEXT).isNull() | (follows > F.col("_first")) | (moment >= F.col("_first"))).drop("_first")
            both = affected.withColumn("_was", F.struct(F.lit(True).alias("stored"), F.col(_NEXT))).drop(_NEXT).unionByName(once)
            # A change that is stored already is taken once, as stored.
            once = both.groupBy(key, *CHANGE_ORDER).agg(
                F.max_by(F.struct(*[c for c in both.columns if c not in (key, *CHANGE_ORDER)]), F.col("_was").isNotNull()).alias("_row")
            ).select(key, *CHANGE_ORDER, "_row.*")
        held = [new]

        def hold(rows: DataFrame) -> DataFrame:
            held.append(rows.persist())
            return held[-1]

        ordered = next_row(once, [key], CHANGE_ORDER, [*CHANGE_ORDER, "_timestamp"], slice_by, _NEXT, hold)
        changed = ordered.where(F.col("_was").isNull() | ~F.col(f"_was.{_NEXT}").eqNullSafe(F.col(_NEXT)))
        table.merge(changed, batch_id, folded=True)
        for rows in held:
            rows.unpersist()

    each_batch(changes, write, checkpoint)


def read_history(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 16, most_runs: int = 4) -> DataFrame:
    """Versions with valid_from, valid_to and is_current, as stored: nothing is put in order here."""
    rows = history_table(spark, path, schema, key, buckets, most_runs).read().where(IMAGE)
    return rows.withColumns(
        {"valid_from": F.col("_timestamp"), "valid_to": F.col(f"{_NEXT}._timestamp"), "is_current": F.col(_NEXT).isNull()}
    ).drop(_NEXT, "_version")


def as_ltz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})
