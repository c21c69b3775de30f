"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space of every contract here: the ASCII blanks, nothing else.
BLANKS = "\x20\x09-\x0d"
WORD = rf"[^{BLANKS}]+"
WORD_RE = re.compile(WORD)

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def letters(text: str) -> list[bytes]:
    """UTF-8 words of ASCII letters, digits and everything beyond ASCII, with A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")


def folded_words(text: str | None) -> list[bytes]:
    """``letters`` without the empty ones; null has none."""
    return list(filter(None, letters(text))) if text else []


def blank_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII blanks: ``bytes.split`` knows exactly those."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def map_rows(df: DataFrame, schema: StructType | str, make: Callable, rows: int = 512) -> DataFrame:
    """Applies ``make`` to the columns of each Arrow batch of ``df``; it yields columns of the result, batch by batch.

    ``make(iterator of tuples of Python lists) -> iterator of tuples of lists``. Batches are cut into ``rows`` rows, so
    that long texts do not pile up as Python objects.
    """
    schema = schema if isinstance(schema, StructType) else _parse(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)

        def pieces():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    yield tuple(c.to_pylist() for c in part.columns)

        for out in make(pieces()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


#: Bytes of an Arrow batch where operators share workers: a default batch of long texts is tens of megabytes, there and in the JVM.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on Arrow batches of the session end at ``most`` bytes, or at fewer where fewer are set."""
    number, unit = re.match(r"(-?\d+)\s*([kmgtp]?)", spark.conf.get(_BATCH_SETTING).lower()).groups()
    if not 0 < int(number) * 1024 ** " kmgtp".index(unit or " ") <= most:
        spark.conf.set(_BATCH_SETTING, str(most))


#: What this worker keeps from task to task.
_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """A large table that a worker makes once and keeps, one at a time: what it kept under another key goes."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Gives up what the worker keeps, and the memory to the system. Workers live on from operator to operator, so one that needs
    no such table calls this before it works."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _parse(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def as_key(column: Column) -> Column:
    """A value as text that is never null, so that joins and grouping by it share one shuffle."""
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), column.cast("string")))


def packed(df: DataFrame) -> DataFrame:
    """The whole row as one column ``_row``, so that columns added beside it clash with none of its own."""
    return df.select(F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("_row"))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns (``new=old``), so that extra columns of any name do no harm."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


class Recent(dict):
    """A cache of at most two times ``limit`` entries: when full, it turns into the older half, which is looked up too."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def absent(self, keys) -> set:
        """Those of ``keys`` that neither half has; makes room for them."""
        keys, old = set(keys), self.old
        found = {k for k in keys if k not in self and k not in old}
        if len(self) + len(found) > self.limit:
            self.old = dict(self)
            self.clear()
            found = {k for k in keys if k not in self.old}
        return found

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value
