"""Ranking, top-k, latest-per-key and set operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidewatch.functions.exprs import bounded
from slidewatch.functions.scan import rank_by_value

SORT_COLUMNS = {"at_risk": "conversion_at_risk_usd", "drop": "conversion_drop", "mau": "mau"}


def risk_rank(open_rows: DataFrame) -> DataFrame:
    """Rank of every open segment by value at risk, ties by id, without one task seeing all rows."""
    return rank_by_value(open_rows, "conversion_at_risk_usd", "segment_id", "risk_rank")


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(key, "row.*").select(*df.columns)


def top_by(df: DataFrame, score: str, tie: str, n: int, ascending: bool = False) -> DataFrame:
    first = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    return df.orderBy(first, F.col(tie).asc()).limit(n)


def rank_candidates(df: DataFrame, score: str, tie: str, n: int = 50, ascending: bool = False) -> DataFrame:
    """Top ``n`` rows and their rank; the window only ever sees those ``n`` rows."""
    first = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    top = top_by(df, score, tie, n, ascending)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(first, F.col(tie).asc())).cast("long"))


def rank_of_one(df: DataFrame, score: str, key: str, value: str, out: str) -> DataFrame:
    """One row with its rank by ``score`` descending, then ``key``: one more than the number of rows ahead of it."""
    own = df.where(F.col(key) == value)
    mine = own.agg(F.struct(F.max(score).alias("score"), F.max(key).alias("key")).alias("_own"))
    rows = df.withColumn("_own", mine.scalar())
    score_, own_score = F.col(score), F.col("_own.score")
    above = F.when(own_score.isNull(), score_.isNotNull()).otherwise(F.coalesce(score_ > own_score, F.lit(False)))
    ahead = above | (score_.eqNullSafe(own_score) & (F.col(key) < F.col("_own.key")))
    counted = rows.where(ahead).agg(F.struct((F.count(F.lit(1)) + 1).alias(out)))
    return own.withColumn("_rank", counted.scalar()).select(*df.columns, F.col(f"_rank.{out}").alias(out))


def worst_sliding(positions: DataFrame, n: int = 20) -> DataFrame:
    sliding = positions.where(F.col("conv_band") == "sliding").select(
        "segment_id", "cohort", "platform", "conversion_rate", "conversion_drop", "conversion_at_risk_usd"
    )
    return top_by(sliding, "conversion_at_risk_usd", "segment_id", n)


def watch_list(positions: DataFrame) -> DataFrame:
    return (
        positions.where(F.col("conv_band") == "watch")
        .select("segment_id", "cohort", "platform", "conversion_rate", "conversion_drop")
        .orderBy(F.col("conversion_drop").desc_nulls_last(), "segment_id")
    )


def worst_segment(open_rows: DataFrame) -> DataFrame:
    return top_by(open_rows, "conversion_at_risk_usd", "segment_id", 1)


def sort_queue(df: DataFrame, by: str = "at_risk") -> DataFrame:
    return df.orderBy(F.col(SORT_COLUMNS[by]).desc_nulls_last(), F.col("segment_id").asc())


def sort_nulls_last(df: DataFrame, column: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last(), F.col(tie).asc())


def bounded_limit(df: DataFrame, n: int, maximum: int) -> DataFrame:
    return df.limit(bounded(n, maximum))


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each named table, ordered by name."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionAll(one)
    return out.orderBy("table_name")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def search_cases(df: DataFrame, text: str, columns: Sequence[str] = ("segment_id",)) -> DataFrame:
    """Case-insensitive substring search over the given columns."""
    needle = text.strip().lower()
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.col(c)).contains(needle)
    return df.where(hit)


def _tabs() -> dict[str, Column]:
    return {
        "all": F.lit(True),
        "sliding": F.col("conv_band") == "sliding",
        "watch": F.col("conv_band") == "watch",
        "has_fix": F.col("has_matching_experiment"),
        "shipping": F.col("decision_status").isin("approved", "committed"),
    }


def queue_tab(df: DataFrame, tab: str) -> DataFrame:
    """Queue tabs over rows with ``conv_band``, ``has_matching_experiment`` and ``decision_status``."""
    return df.where(_tabs()[tab])


def queue_tabs(df: DataFrame, out: str = "tab") -> DataFrame:
    """Every row once for each tab that shows it; the rows are read once."""
    names = [F.when(condition, F.lit(name)) for name, condition in _tabs().items()]
    return df.withColumn(out, F.explode(F.array_compact(F.array(*names))))
