"""Join shapes used by the growth model. Join strategy is left to Catalyst and AQE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidewatch.session import size_in_bytes

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def join_inner(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key)


def join_left(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left")


def join_full(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join; the key of the result is that of whichever side has the row."""
    return a.join(b, key, "full_outer")


def join_anti(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left_anti")


def join_semi(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left_semi")


def join_multi(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return a.join(b, list(keys), how)


def cross_with_list(a: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Every row with every entry of a short literal list, made inside the row instead of by a cross join."""
    return a.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))


def broadcast_dim(a: DataFrame, dim: DataFrame, key: str, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcasts ``dim`` only while its estimated size is within ``limit``; else a shuffled join under AQE."""
    small = size_in_bytes(dim) <= limit
    return a.join(F.broadcast(dim) if small else dim, key)


def attach_scalar(a: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row, as a scalar subquery (null when the aggregate is null)."""
    names = one_row.columns
    packed = a.withColumn("_scalar", one_row.select(F.struct(*names)).scalar())
    return packed.select(*a.columns, *[F.col(f"_scalar.{n}").alias(n) for n in names])


def proven_fixes(open_rows: DataFrame, experiments: DataFrame, n: int = 10) -> DataFrame:
    """Open segments with a won matching experiment, by value at risk."""
    won = experiments.where(F.col("won")).select("experiment_id", "description", "observed_lift")
    matched = open_rows.where(F.col("has_matching_experiment")).withColumnRenamed(
        "matching_experiment_id", "experiment_id"
    )
    return (
        matched.join(won, "experiment_id")
        .select(
            "segment_id", "cohort", "platform", "region", "conversion_at_risk_usd", "conversion_drop",
            "experiment_id", "description", "observed_lift",
        )
        .orderBy(F.col("conversion_at_risk_usd").desc_nulls_last(), "segment_id")
        .limit(n)
    )
