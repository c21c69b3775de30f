"""Ordered calculations within a key that do not need the whole key in one task.

A plain window over (key) puts every row of the key into one task. Here each key is cut into slices along the
order column (an hour, a day, a block of log positions). A window runs inside (key, slice); the effect of earlier
slices is one small row per slice, gathered by aggregation and added back. The slice expression must be a
deterministic, non-decreasing function of the leading order column.

The input is computed and shuffled once: window and aggregate both start from the same shuffle on (key, slice), which Spark
reuses where both ask it for the same columns. So both take a hash of all columns and drop it again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from slidewatch.session import work_path

_SLICE = "_slice"


def _sliced(df: DataFrame, keys: Sequence[str], slice_by: Column) -> DataFrame:
    return df.withColumn(_SLICE, slice_by).repartition(*keys, _SLICE)


def _all_columns(sliced: DataFrame) -> Column:
    return F.min(F.xxhash64(*[f.name for f in sliced.schema.fields if "map<" not in f.dataType.simpleString()]))


def _per_slice(sliced: DataFrame, keys: Sequence[str], *columns: Column) -> DataFrame:
    """One row per (key, slice)."""
    rows = sliced.groupBy(*keys, _SLICE).agg(*columns, _all_columns(sliced).alias("_seen"))
    return rows.where(F.col("_seen").isNotNull()).drop("_seen")


def _opaque(columns: Sequence[str], across: WindowSpec) -> list[Column]:
    """The columns as values of a window: what a join infers of its keys is then not pushed below the shuffle, where it would
    make the two uses differ."""
    return [F.max(c).over(across.rowsBetween(0, 0)).alias(c) for c in columns]


def _per_row(sliced: DataFrame, name: str, column: Column, inside: WindowSpec) -> DataFrame:
    """Adds a window's column."""
    rows = sliced.withColumns({name: column.over(inside), "_seen": _all_columns(sliced).over(inside)})
    return rows.where(F.col("_seen").isNotNull()).drop("_seen")


def _ordered(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc() for c in order]


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], slice_by: Column, out: str
) -> DataFrame:
    """Adds struct ``out`` holding ``values`` of the preceding row of the key (null for the first row)."""
    return _neighbour(df, keys, order, values, slice_by, out, forward=False)


def next_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], slice_by: Column, out: str,
    hold: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Adds struct ``out`` holding ``values`` of the following row of the key (null for the last row).

    ``hold`` may persist the shuffled rows, where Spark does not reuse their shuffle, as over persisted frames.
    """
    return _neighbour(df, keys, order, values, slice_by, out, forward=True, hold=hold)


def _neighbour(df, keys, order, values, slice_by, out, forward, hold=None):
    sliced = _sliced(df, keys, slice_by)
    sliced = hold(sliced) if hold else sliced
    step = F.lead if forward else F.lag
    edge = F.min_by if forward else F.max_by
    payload = F.struct(*values)
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*_ordered(order))
    across = Window.partitionBy(*keys).orderBy(_SLICE)
    edges = _per_slice(sliced, keys, edge(payload, F.struct(*order)).alias("_edge"))
    carried = edges.select(*_opaque([*keys, _SLICE], across), step("_edge").over(across).alias("_carried"))
    return (
        _per_row(sliced, "_local", step(payload), inside)
        .join(carried, [*keys, _SLICE], "left")
        .withColumn(out, F.coalesce("_local", "_carried"))
        .drop("_local", "_carried", _SLICE)
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, slice_by: Column, out: str
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the key's rows up to and including this one."""
    sliced = _sliced(df.withColumn("_value", value), keys, slice_by)
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*_ordered(order)).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(_SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    totals = _per_slice(sliced, keys, F.sum("_value").alias("_total"))
    carried = totals.select(*_opaque([*keys, _SLICE], across), F.sum("_total").over(before).alias("_before"))
    joined = _per_row(sliced, "_local", F.sum("_value"), inside).join(carried, [*keys, _SLICE], "left")
    kind = joined.schema["_local"].dataType
    if isinstance(kind, T.DecimalType):
        kind = T.DecimalType(37, kind.scale)  # one digit of room, so that the addition keeps the scale
    total = F.col("_local").cast(kind) + F.coalesce(F.col("_before").cast(kind), F.lit(0).cast(kind))
    return joined.withColumn(out, total).drop("_value", "_local", "_before", _SLICE)


def row_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, out: str
) -> DataFrame:
    """Adds ``out``: the 1-based position of the row within its key."""
    return running_total(df, keys, order, F.lit(1).cast("long"), slice_by, out)


def join_by_slice(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], slice_by: Column, how: str = "inner"
) -> DataFrame:
    """Joins rows with one row per key, spread on (key, slice) instead of on the key.

    AQE does not split a hot key here, as the per-key side is an aggregate with no shuffle of its own.
    """
    sliced = _sliced(rows, keys, slice_by)
    spread = _per_slice(sliced, keys).join(per_key, list(keys), how)
    return sliced.join(spread, [*keys, _SLICE], how).drop(_SLICE)


def rank_by_value(df: DataFrame, value: str, tie: str, out: str, partitions: int | None = None) -> DataFrame:
    """Global 1-based rank by ``value`` descending (null last), then ``tie`` ascending.

    Rows are put into ranges of (value, tie) that Spark cuts by their numbers, however values are spread, and are written
    in order with their place in the range. A rank is that place and the sizes of the ranges before: the only window
    without a key sees one row per range. The table is written because ranges that were drawn twice need not agree.
    """
    order = [F.col(value).desc_nulls_last(), F.col(tie).asc()]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ids = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    placed = ranged.sortWithinPartitions(*order).select(
        *df.columns, F.shiftright(ids, 33).alias("_range"), ids.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")
    )
    path = work_path(df.sparkSession, "ranked")
    placed.write.parquet(path)
    placed = df.sparkSession.read.parquet(path)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    ranked = placed.join(F.broadcast(starts), "_range")  # one row per range
    return ranked.select(*df.columns, (F.col("_start") + F.col("_place") + 1).cast("long").alias(out))
