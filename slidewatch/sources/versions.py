"""Numbered versions of a table: a version counts from the moment its whole write was committed.

Spark's file committer puts ``_SUCCESS`` beside the files of a finished write, so a version that was torn off has none and is
never read. Writing a number again replaces what was torn off; a finished number is left as it is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from slidewatch.sources.tables import key_violations, select_cast


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none where it is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.removeprefix("v=")) for n in names_in(spark, root) if n.startswith("v="))


def live(spark: SparkSession, root: str) -> int | None:
    """The greatest finished version."""
    for number in reversed(numbers(spark, root)):
        if "_SUCCESS" in names_in(spark, version_path(root, number)):
            return number
    return None


def version_path(root: str, number: int) -> str:
    return f"{root}/v={number}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def publish_version(df: DataFrame, root: str, columns: Mapping[str, str | None], key: str) -> DataFrame:
    """Writes a new version of a serving table, checks its key, and only then points readers to it.

    The rows stand in ``root/data/v=N``; the pointer is a one-row table ``root/live/v=N``. A version whose key is null or
    repeated raises ValueError and is never pointed to, so readers keep the former one; its number is not used again.
    """
    spark = df.sparkSession
    number = max([-1, *numbers(spark, f"{root}/data")]) + 1
    path = version_path(f"{root}/data", number)
    select_cast(df, columns).write.mode("errorifexists").parquet(path)
    found = key_violations(spark.read.parquet(path), key).first()
    if found["null_keys"] or found["repeated_keys"]:
        raise ValueError(f"{path}: {found['null_keys']} null and {found['repeated_keys']} repeated values of {key}")
    spark.range(1).selectExpr(f"{number}L AS number").coalesce(1).write.mode("overwrite").parquet(version_path(f"{root}/live", number))
    return spark.read.parquet(path)


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The live version of a published table, or an earlier one by its number."""
    number = live(spark, f"{root}/live") if number is None else number
    if number is None:
        raise FileNotFoundError(f"{root}: nothing is published")
    return spark.read.parquet(version_path(f"{root}/data", number))


def published(spark: SparkSession, root: str) -> Sequence[int]:
    """Numbers that readers were pointed to, oldest first."""
    return [n for n in numbers(spark, f"{root}/live") if "_SUCCESS" in names_in(spark, version_path(f"{root}/live", n))]
