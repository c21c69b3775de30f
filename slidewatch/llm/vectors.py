"""What the two vector operators of this subpackage share: valid rows, Arrow to numpy, blocks of queries, levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors of queries that the driver holds and sends to the tasks at once.
BLOCK_BYTES = 32 * 1024 * 1024


def finite(column: str) -> Column:
    """True for a vector without a null, NaN or infinite component; false for a null vector."""
    good = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & good, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all have ``dim`` values, as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def ids_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and a mask of nulls (whose number is 0)."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def runs_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of at most ``rows`` rows."""
    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - size)
            held.append(part)
            at, size = at + part.num_rows, size + part.num_rows
            if size == rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def block_count(rows: int, dim: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, -(-rows * 8 * max(1, dim) // block_bytes))


def best_rows(group: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the first ``keep`` rows of each group: highest score first, then smaller id, null last."""
    order = np.lexsort((ids, null, -score, group))
    group = group[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    place = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    return order[place < keep]
