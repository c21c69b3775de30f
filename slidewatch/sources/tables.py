"""Reading raw datasets, publishing serving tables and keeping mirrors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidewatch.operators.rank import union_counts


def raw_path(root: str, name: str, suffix: str = "") -> str:
    return f"{root.rstrip('/')}/{name.removeprefix('raw_')}{suffix}"


def read_raw(
    spark: SparkSession, root: str, name: str, schema: T.StructType | None = None, suffix: str = ""
) -> DataFrame:
    """Raw dataset by logical name. With a declared schema no file is opened before the job runs."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(raw_path(root, name, suffix))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_optional(spark: SparkSession, source: str, schema: T.StructType) -> DataFrame:
    """A table or path that may be missing; a missing one is an empty frame of the given schema."""
    if path_exists(spark, source):
        return spark.read.schema(schema).parquet(source)
    if "/" not in source and spark.catalog.tableExists(source):
        return spark.table(source)
    return spark.createDataFrame([], schema)


def save_verified(df: DataFrame, path: str) -> DataFrame:
    """Writes the dataset and counts what can be read back, as one row (path, row_count)."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(path).alias("path"), "row_count")


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """One row: rows with a null key, and keys that occur more than once."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_n"))), F.lit(0)).alias("null_keys"),
        F.count(F.when(F.col(key).isNotNull() & (F.col("_n") > 1), 1)).alias("repeated_keys"),
    )


def select_cast(df: DataFrame, columns: Mapping[str, str | None]) -> DataFrame:
    """The named columns, cast where a type is given."""
    return df.select(*[F.col(c).cast(t).alias(c) if t else F.col(c) for c, t in columns.items()])


def publish(df: DataFrame, path: str, columns: Mapping[str, str | None], key: str) -> DataFrame:
    """Writes a serving table: the named columns, cast where a type is given, with a checked non-null unique key.

    The key is checked on the written files, so the source is computed once; a table that fails is reported by an
    exception and its path must not be used.
    """
    spark = df.sparkSession
    select_cast(df, columns).write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    found = key_violations(table, key).first()
    if found["null_keys"] or found["repeated_keys"]:
        raise ValueError(f"{path}: {found['null_keys']} null and {found['repeated_keys']} repeated values of {key}")
    return table


def sync_once(source: DataFrame, path: str, schema: T.StructType | None = None, force: bool = False) -> bool:
    """Fills the target only when it is missing or empty, or when forced. Returns whether it wrote."""
    spark = source.sparkSession
    if not force and path_exists(spark, path) and not read_optional(spark, path, schema or source.schema).isEmpty():
        return False
    source.write.mode("overwrite").parquet(path)
    return True


def new_rows(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Source rows whose key the target lacks, one per key."""
    return source.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def append_new(source: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows with new keys; existing rows win, as in an insert that ignores conflicts."""
    spark = source.sparkSession
    fresh = new_rows(source, read_optional(spark, path, source.schema), key)
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def mirror_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_counts(tables)


def reset_mirrors(spark: SparkSession, sources: Mapping[str, DataFrame], paths: Mapping[str, str], decisions_path: str, schema: T.StructType) -> Sequence[str]:
    """Empties the decision table and fills every mirror again from its source. Returns the mirror names."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(decisions_path)
    for name, source in sources.items():
        sync_once(source, paths[name], force=True)
    return list(sources)
