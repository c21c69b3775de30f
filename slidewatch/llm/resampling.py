"""Importance resampling: documents drawn so that their word runs look like those of a target set.

Words come from the tokenizers library's pre-tokenisation: an untrained ``Split`` by a regular expression over text with
A-Z lowered, which returns each word with its offsets. A feature is a run of one to ``runs`` consecutive words joined by
one space, that is the window between the start of its first word and the end of its last in the joined words. Its bucket
is the CRC-32 of that window modulo the number of buckets. With the checksum of everything before each word's start and
end at hand, a window's own checksum follows from its pair of offsets alone::

    crc(start, end) = crc(0, end) ^ moved(crc(0, start), end - start)

where ``moved`` carries a checksum over that many bytes, a table per distance. So all windows of a batch are a few array
operations, whatever their length.

1. Every document's buckets are written once, in the shared folder, two bytes a feature.
2. Bucket histograms of documents and of the target: each task counts its own rows, then the counts are added.
3. The gain of a bucket is the scaled log ratio of its smoothed frequencies. The table of gains has one number a bucket, so
   it goes to every task; a document's weight is the sum of its features' gains.
4. The score adds a Gumbel variable taken from a hash of the id, so that the highest scores are a draw without replacement by
   weight, the same on every run. Places come from a range partition of the scores: a row's place is its place in its range
   and the sizes of the ranges before, so no task sees all rows, and rows that are equal in everything have a number of their
   own that spreads them.

Bounds: a text is split in pieces of ``PIECE`` characters, cut between words, and windows are made for at most about ``WORDS``
words at once; a run of words that goes on in the next piece or batch is carried over, so texts of any length are whole.

Defined results: null and empty texts have no words, no features and weight 0; a null doc_id draws by the text ``42:`` and
comes last among ties; repeated rows are documents of their own (all features count each time, each may be drawn); without
a target every gain is that of t = 0; an empty table gives no rows; other columns are not looked at. doc_id is read as long.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidewatch.llm.common import pick
from slidewatch.session import work_path

BUCKETS = 10_000
#: Characters that one call of the pre-tokenizer reads, and words whose windows are made at once.
PIECE = 2048
WORDS = 30_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: The reflected CRC-32 polynomial. Fixed value.
_POLYNOMIAL = 0xEDB88320


@lru_cache(maxsize=1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[int, str]]:
    """(offset, part) of a text in parts of about ``size`` characters, cut where no word is."""
    at = 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + size) if len(text) - at > size else None
        end = cut.start() if cut else len(text)
        yield at, text[at:end]
        at = end


def words_with_offsets(text: str) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """UTF-8 words of each piece of a text, A-Z lowered, and the offsets (start, end) of each in its words joined by one space."""
    split = _splitter().pre_tokenize_str
    # bytes.lower lowers A-Z alone.
    for _, part in pieces(text.encode("utf-8").lower().decode("utf-8")):
        found = split(part)
        words = " ".join([w for w, _ in found]).encode("utf-8").split(b" ") if found else []
        if part.isascii():
            spans = np.array([span for _, span in found], np.int64).reshape(-1, 2)
            lengths = spans[:, 1] - spans[:, 0]
        else:  # the library counts characters
            lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        yield words, np.stack([ends - lengths, ends], axis=1)


class Moved:
    """Carries CRC-32 values over a number of bytes: ``crc(a + b) == moved(crc(a), len(b)) ^ crc(b)``.

    Carrying is linear, so a value is looked up byte by byte. There is a table for every distance below ``NEAR`` and one
    for each power of two from there on.
    """

    NEAR = 128

    def __init__(self) -> None:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1)
        table = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
        near = []
        for _ in range(self.NEAR + 1):
            near.append(table)
            table = step[table & 0xFF] ^ (table >> 8)
        self.near, self.far = np.stack(near[: self.NEAR]), [near[self.NEAR]]

    @staticmethod
    def _look_up(table: np.ndarray, value: np.ndarray) -> np.ndarray:
        return table[0][value & 255] ^ table[1][(value >> 8) & 255] ^ table[2][(value >> 16) & 255] ^ table[3][value >> 24]

    def __call__(self, value: np.ndarray, distance: np.ndarray) -> np.ndarray:
        short, near = distance % self.NEAR, self.near
        out = near[short, 0, value & 255] ^ near[short, 1, (value >> 8) & 255]
        out ^= near[short, 2, (value >> 16) & 255] ^ near[short, 3, value >> 24]
        rest, k = distance // self.NEAR, 0
        while rest.any():
            if k == len(self.far):
                self.far.append(self._look_up(self.far[-1], self.far[-1]))
            out = np.where(rest & 1, self._look_up(self.far[k], out), out)
            rest, k = rest >> 1, k + 1
        return out


class Windows:
    """Buckets of all runs of 1 to ``runs`` words of texts that come one after the other."""

    def __init__(self, runs: int, buckets: int):
        self.runs, self.buckets, self.moved = runs, buckets, Moved()
        self.kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
        self.blank = zlib.crc32(b" ")
        none = np.empty(0, np.int64)
        self.held, self.size, self.carried = [(none, none, none.astype(np.uint32))], 0, 0

    def add(self, owner: int, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (owner, bucket) arrays as soon as enough words are there; ``rest`` gives what is left."""
        for words, offsets in words_with_offsets(text):
            crcs = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
            self.held.append((np.full(len(words), owner), offsets[:, 1] - offsets[:, 0], crcs))
            self.size += len(words)
            if self.size >= WORDS:
                yield self._made(self.runs - 1)

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        return self._made(0)

    def _made(self, carry: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows that end in a word that was not carried over; one owner's words stand together. Keeps ``carry`` words."""
        owners, lengths, crcs = (np.concatenate(x) for x in zip(*self.held))
        # A word with the blank before it, by which a window grows.
        grown = self.moved(np.full(len(crcs), self.blank, np.uint32), lengths) ^ crcs
        whose, found, crc = [], [], crcs
        for run in range(1, self.runs + 1):
            if run > 1:
                crc = self.moved(crc[:-1], lengths[run - 1 :] + 1) ^ grown[run - 1 :]
            fresh = np.arange(len(crc)) + run > self.carried
            fresh &= owners[: len(crc)] == owners[run - 1 : run - 1 + len(crc)]
            whose.append(owners[: len(crc)][fresh])
            found.append((crc[fresh] % self.buckets).astype(self.kind))
        keep = slice(max(0, len(owners) - carry), len(owners))
        self.held, self.carried = [(owners[keep], lengths[keep], crcs[keep])], len(owners[keep])
        self.size = self.carried
        return np.concatenate(whose), np.concatenate(found)


def _rows(batches: Iterator[pa.RecordBatch], rows: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [c.to_pylist() for c in part.columns]


def features(docs: DataFrame, runs: int = 3, buckets: int = BUCKETS, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, the bucket of every feature, and a number of the row within its task."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def read(batches):
        windows, number = Windows(runs, buckets), 0
        for ids, texts in _rows(batches):
            own: list[list[bytes]] = [[] for _ in ids]

            def keep(made):
                whose, found = made
                order = np.argsort(whose, kind="stable")
                who, at = np.unique(whose[order], return_index=True)
                for k, part in zip(who.tolist(), np.split(found[order], at[1:])):
                    own[k].append(part.tobytes())

            for k, text in enumerate(texts):
                for made in windows.add(k, text or ""):
                    keep(made)
            keep(windows.rest())
            joined = [b"".join(x) for x in own]
            width = np.dtype(kind).itemsize
            counts = [len(x) // width for x in joined]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([_words_of(n, runs) for n in counts], pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(joined, pa.binary()), pa.array(range(number, number + len(ids)), pa.int64()),
                ],
                ["doc_id", "n_words", "n_features", "buckets", "number"],
            )
            number += len(ids)

    rows = pick(docs, _text=text_col, **({"_id": id_col} if id_col else {}))
    rows = rows.select(F.col("_id").cast("long") if id_col else F.lit(None).cast("long").alias("_id"), "_text")
    return rows.mapInArrow(read, "doc_id long, n_words long, n_features long, buckets binary, number long")


def _words_of(n_features: int, runs: int) -> int:
    """The number of words that have so many runs: n + (n - 1) + ... of them."""
    words = 0
    while words < runs and sum(max(0, words - k) for k in range(runs)) < n_features:
        words += 1
    return words if words < runs else (n_features + runs * (runs - 1) // 2) // runs


def histogram(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows of ``features``: every task counts its rows first."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(np.frombuffer(data.as_buffer(), kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    counts = found.select("buckets").mapInArrow(counted, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of smoothed frequencies, rounded down, per bucket."""
    n = float(len(source))
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _table(counts: DataFrame, buckets: int) -> np.ndarray:
    """A histogram as an array: one number a bucket, the only thing that comes to the driver."""
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, number and weight of each row of ``features``."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def summed(batches):
        for batch in batches:
            sums = [int(gain[np.frombuffer(x.as_buffer(), kind)].sum()) for x in batch.column("buckets")]
            kept = [batch.column(c) for c in ("doc_id", "n_words", "n_features", "number")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64())], ["doc_id", "n_words", "n_features", "number", "weight"])

    return found.mapInArrow(summed, "doc_id long, n_words long, n_features long, number long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, runs: int = 3, buckets: int = BUCKETS, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank (null where it is not drawn).

    Of the documents with ``least_words`` words or more, ``percent`` of a hundred are drawn, rounded down.
    """
    spark = docs.sparkSession
    path = work_path(spark, "resampling_features")
    features(docs, runs, buckets, id_col, text_col).write.parquet(path)
    found = spark.read.parquet(path)
    aims = features(target, runs, buckets, None, target_col)
    gain = gains(_table(histogram(found, buckets), buckets), _table(histogram(aims, buckets), buckets))

    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    u = (u.cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    scored = weights(found, gain).withColumn("score", F.col("weight") + F.floor(F.lit(-1000) * F.log(-F.log(u))))
    path = work_path(spark, "resampling_scores")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("number").asc()]
    ranged = scored.repartitionByRange(F.expr(f"n_words < {int(least_words)}"), *order)
    ranged = ranged.sortWithinPartitions(F.expr(f"n_words < {int(least_words)}"), *order)
    ranged.withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    ranged = spark.read.parquet(path).withColumn("range", F.shiftrightunsigned("place", 33))

    # One row per range: its documents that may be drawn, which stand before the others there and in all later ranges.
    sizes = ranged.groupBy("range").agg(F.count_if(F.col("n_words") >= least_words).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    drawn = int(sizes.agg(F.sum("n")).first()[0] or 0) * int(percent) // 100
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rank = F.when((F.col("n_words") >= least_words) & (rank <= drawn), rank)
    return ranged.join(F.broadcast(before), "range").select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
