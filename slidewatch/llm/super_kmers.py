"""Exact substring dedup over word windows, with super-k-mers.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the least hash among its runs of three words,
so equal windows have equal minimisers, and neighbouring windows mostly share theirs: they travel together as one packed
string, a super-k-mer, to the minimiser's bucket. There, sorting brings equal windows together; the words themselves are
compared, so a result never rests on a hash.

* A first pass counts windows per minimiser slot over all texts. Slots that would fill half a bucket on their own (a line
  in a third of all documents) are hot: their windows travel singly, by a hash of the whole window. There are at most two
  hot slots per bucket, so the list is bounded.
* Equal super-k-mers of a chunk of documents become one string with the list of its places before the shuffle, and a chunk
  sends one compressed pack per bucket. Copies of a document cost one string per chunk.
* A bucket gives back spans of words to remove: all places of a super-k-mer but the first, and in the first one the
  windows that occur earlier elsewhere. Spans are grouped by document and joined to the texts.

Order of documents: by doc_id, null last; rows that share a doc_id but not their text are different documents, ordered by
a checksum of the text. Equal rows are one place, and each gets the same result. Windows are judged on the input.

Defined results: null and empty texts have no words (kept_sha256 is that of nothing); texts shorter than a window stay
whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidewatch.llm.common import blank_words, map_rows, pick
from slidewatch.session import work_path

WINDOW = 20
RUN = 3
SLOTS = 1 << 16
#: Words that are cut into super-k-mers at once, a bound of a task's memory.
CHUNK_WORDS = 600_000
#: Bytes that are hashed at once.
BLOCK = 1 << 18
#: Windows of one super-k-mer at most; equal words in a row share a minimiser without end.
LONGEST = 64
#: Buckets per shuffle partition: a bucket is held in memory as a whole, a partition is not.
BUCKETS_PER_PARTITION = 4

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))
_NULL_ID = (1 << 63) - 1


def spread_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[3]
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def window_hashes(x: np.ndarray, window: int) -> np.ndarray:
    """A hash of each ``window`` neighbouring values, by their order; put together from powers of two."""
    if len(x) < window:
        return x[:0]
    done, size, part, have = None, 0, x, 1
    while True:
        if window & have:
            n = len(part) - size
            done = part if done is None else done[:n] * _power(have) + part[size : size + n]
            size += have
        if 2 * have > window:
            return spread_bits(done)
        part = part[: len(part) - have] * _power(have) + part[have:]
        have *= 2


def _power(exponent: int) -> np.uint64:
    return np.uint64(pow(int(_MIX[0]), exponent, 1 << 64))


@lru_cache(maxsize=2)
def _byte_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = int(_MIX[1])
    both = np.ones((2, n), np.uint64)
    both[0, 1:], both[1, 1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
    return tuple(np.multiply.accumulate(both, axis=1))


def word_hashes(line: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and a hash of each word of ``line``, whose words are separated by single blanks.

    A word's hash is a difference of running sums over its bytes, so no word becomes a Python object.
    """
    data = np.frombuffer(line, np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = np.empty(len(ends), np.uint64)
    at = 0
    while at < len(ends):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        part = data[base : int(ends[stop - 1])].astype(np.uint64)
        up, down = _byte_powers(max(BLOCK, len(part)) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[: len(part)], out=sums[1:])
        first, last = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (sums[last] - sums[first]) * down[first]
        at = stop
    return starts, ends, spread_bits(out)


def text_key(data: bytes) -> int:
    """63 bits that tell texts apart which share an id or have none: CRC-32 first, so that it orders them, then XXH64."""
    return zlib.crc32(data) << 31 | xxhash.xxh64_intdigest(data, 42) >> 33


def chunks(batches, chunk_words: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(doc ids, text checksums, words joined by a blank) of runs of documents with about ``chunk_words`` words."""
    ids, crcs, lines, size = [], [], [], 0
    for batch_ids, batch_texts in batches:
        for doc, text in zip(batch_ids, batch_texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            words = data.split()
            if len(words) < WINDOW:
                continue
            ids.append(doc)
            crcs.append(text_key(data))
            lines.append(b" ".join(words))
            size += len(words)
            if size >= chunk_words:
                yield ids, crcs, lines
                ids, crcs, lines, size = [], [], [], 0
    if ids:
        yield ids, crcs, lines


class Cut:
    """Super-k-mers of a chunk: first word, number of windows and slot of each; all places count words of the chunk."""

    def __init__(self, lines: list[bytes]):
        lengths = np.array([line.count(b" ") + 1 for line in lines])
        self.line = b" ".join(lines)
        self.ends = np.cumsum(lengths)
        self.word_starts, self.word_ends, self.x = word_hashes(self.line)
        least = sliding_min(window_hashes(self.x, RUN), WINDOW - RUN + 1)
        starts = np.arange(len(least))
        inside = starts + WINDOW <= np.repeat(self.ends, lengths)[: len(least)]
        starts, least = starts[inside], least[inside]
        new = np.empty(len(starts), bool)
        new[:1] = True
        new[1:] = (starts[1:] != starts[:-1] + 1) | (least[1:] != least[:-1])
        at = np.arange(len(starts))
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % LONGEST == 0
        heads = np.flatnonzero(new)
        self.first = starts[heads]
        self.windows = np.diff(np.append(heads, len(starts)))
        self.minimiser = least[heads]

    def slots(self, slots: int) -> np.ndarray:
        return (self.minimiser >> np.uint64(32)).astype(np.int64) % slots

    def split_hot(self, hot: np.ndarray, buckets: int) -> np.ndarray:
        """The bucket of each super-k-mer, after those of hot slots were taken apart into single windows."""
        slot = self.slots(len(hot))
        bucket = slot % buckets
        taken = hot[slot]
        if taken.any():
            n = self.windows[taken]
            single = np.repeat(self.first[taken], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            by_window = (window_hashes(self.x, WINDOW)[single] >> np.uint64(20)).astype(np.int64) % buckets
            self.first = np.concatenate([self.first[~taken], single])
            self.windows = np.concatenate([self.windows[~taken], np.ones(len(single), np.int64)])
            bucket = np.concatenate([bucket[~taken], by_window])
        return bucket


def pack(strings: list[bytes], counts: np.ndarray, docs: np.ndarray, crcs: np.ndarray, starts: np.ndarray) -> bytes:
    text = b"\n".join(strings)
    head = np.array([len(text), len(counts), len(docs)], "<i8").tobytes()
    body = b"".join([
        head, text, counts.astype("<i4").tobytes(), docs.astype("<i8").tobytes(), crcs.astype("<i8").tobytes(),
        starts.astype("<i4").tobytes(),
    ])
    return zstandard.ZstdCompressor(level=3).compress(body)


def unpack(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    size, n, m = np.frombuffer(body, "<i8", 3).tolist()
    at = 24 + size
    counts = np.frombuffer(body, "<i4", n, at)
    docs = np.frombuffer(body, "<i8", m, at + 4 * n)
    crcs = np.frombuffer(body, "<i8", m, at + 4 * n + 8 * m)
    starts = np.frombuffer(body, "<i4", m, at + 4 * n + 16 * m)
    return body[24 : 24 + size].split(b"\n"), counts, docs, crcs, starts


def packs(ids: list[int], crcs: list[int], lines: list[bytes], hot: np.ndarray, buckets: int):
    """(bucket, pack) of each bucket that a chunk has super-k-mers for."""
    cut = Cut(lines)
    bucket = cut.split_hot(hot, buckets)
    if not len(bucket):
        return
    joined = cut.line
    begins = cut.word_starts[cut.first].tolist()
    stops = cut.word_ends[cut.first + cut.windows + WINDOW - 2].tolist()
    known: dict[bytes, int] = {}
    group = np.array([known.setdefault(joined[a:b], len(known)) for a, b in zip(begins, stops)])
    strings = list(known)
    # Equal strings are in one bucket. Number them by bucket, then put places in that order.
    bucket_of = np.empty(len(strings), np.int64)
    bucket_of[group] = bucket
    by_bucket = np.argsort(bucket_of, kind="stable")
    number = np.empty(len(strings), np.int64)
    number[by_bucket] = np.arange(len(strings))
    order = np.argsort(number[group], kind="stable")
    counts = np.bincount(number[group], minlength=len(strings))
    doc = np.searchsorted(cut.ends, cut.first[order], side="right")
    begin_of = np.concatenate([[0], cut.ends])[doc]
    docs, sums = np.array([_NULL_ID if i is None else i for i in ids], np.int64)[doc], np.array(crcs, np.int64)[doc]
    starts = cut.first[order] - begin_of
    places = np.concatenate([[0], np.cumsum(counts)])
    sorted_buckets = bucket_of[by_bucket]
    edges = np.flatnonzero(np.diff(sorted_buckets, prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(strings)]):
        p, q = places[a], places[b]
        yield int(sorted_buckets[a]), pack(
            [strings[k] for k in by_bucket[a:b].tolist()], counts[a:b], docs[p:q], sums[p:q], starts[p:q]
        )


def repeats(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, checksum, first word, stop word) of the spans to remove that one bucket's packs show."""
    known: dict[bytes, int] = {}
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for data in held:
        strings, counts, docs, crcs, starts = unpack(data)
        numbers = np.array([known.setdefault(s, len(known)) for s in strings])
        for column, values in zip(columns, (np.repeat(numbers, counts), docs, crcs.astype(np.int64), starts.astype(np.int64))):
            column.append(values)
    string, doc, crc, start = map(np.concatenate, columns)
    order = np.lexsort((start, crc, doc, string))
    string, doc, crc, start = string[order], doc[order], crc[order], start[order]
    lead = np.diff(string, prepend=-1) != 0
    same = np.zeros(len(lead), bool)
    same[1:] = ~lead[1:] & (doc[1:] == doc[:-1]) & (crc[1:] == crc[:-1]) & (start[1:] == start[:-1])
    strings = list(known)
    sizes = np.fromiter((s.count(b" ") + 1 for s in strings), np.int64, len(strings))
    # Equal documents share a place; a place is removed whole unless it is the string's first.
    heads = np.flatnonzero(lead)
    later = ~lead & ~same
    out = [(doc[later], crc[later], start[later], start[later] + sizes[string[later]])]

    # First places, in the order of documents: then equal windows stand in order too.
    doc, crc, start, string = doc[heads], crc[heads], start[heads], string[heads]
    order = np.lexsort((start, crc, doc))
    doc, crc, start, string = doc[order], crc[order], start[order], string[order]
    sizes = sizes[string]
    line = b" ".join([strings[k] for k in string.tolist()])
    word_starts, word_ends, x = word_hashes(line)
    mixed = window_hashes(x, WINDOW)
    n = sizes - WINDOW + 1
    owner = np.repeat(np.arange(len(sizes)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = base[owner] + inside
    value = mixed[at]
    order = np.argsort(value, kind="stable")
    head = np.empty(len(order), bool)
    head[:1] = True
    ranked = value[order]
    np.not_equal(ranked[1:], ranked[:-1], out=head[1:])
    place = np.arange(len(order))
    front = at[order][np.maximum.accumulate(np.where(head, place, 0))]
    members = np.flatnonzero(~head)
    mine, theirs = at[order[members]], front[members]
    places = [word_starts[mine], word_ends[mine + WINDOW - 1], word_starts[theirs], word_ends[theirs + WINDOW - 1]]
    same_bytes = (line[a:b] == line[c:d] for a, b, c, d in zip(*[p.tolist() for p in places]))
    equal = np.fromiter(same_bytes, bool, len(members))
    marked = np.zeros(len(at), bool)
    marked[order[members[equal]]] = True
    for h in set(ranked[members[~equal]].tolist()):
        _mark_by_words(h, value, line, word_starts[at], word_ends[at + WINDOW - 1], marked)
    hit = np.flatnonzero(marked)
    if len(hit):
        gap = np.ones(len(hit), bool)
        gap[1:] = (owner[hit[1:]] != owner[hit[:-1]]) | (hit[1:] != hit[:-1] + 1)
        begin = hit[gap]
        end = hit[np.append(np.flatnonzero(gap)[1:] - 1, len(hit) - 1)]
        o = owner[begin]
        out.append((doc[o], crc[o], start[o] + inside[begin], start[o] + inside[end] + WINDOW))
    return tuple(np.concatenate(c) for c in zip(*out))


def _mark_by_words(h: int, value: np.ndarray, line: bytes, starts: np.ndarray, ends: np.ndarray, marked: np.ndarray) -> None:
    """Windows of one hash value that different words share: marked by the words alone."""
    seen = set()
    for k in np.flatnonzero(value == np.uint64(h)).tolist():
        words = line[starts[k] : ends[k]]
        marked[k] = words in seen
        seen.add(words)


def _spans(docs: DataFrame, buckets: int, slots: int) -> DataFrame:
    """doc, crc, start, stop: words of ``docs`` (columns _id, _text) to remove."""
    spark = docs.sparkSession

    def loads(batches):
        total = np.zeros(slots, np.int64)
        for _, _, lines in chunks(batches, CHUNK_WORDS):
            cut = Cut(lines)
            total += np.bincount(cut.slots(slots), cut.windows, slots).astype(np.int64)
        used = np.flatnonzero(total)
        yield used.tolist(), total[used].tolist()

    load = map_rows(docs, "slot int, n long", loads).groupBy("slot").agg(F.sum("n").alias("n"))
    path = work_path(spark, "super_kmer_slots")
    load.write.parquet(path)
    load = spark.read.parquet(path)
    total = load.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most 2 * buckets slots can hold more than half a bucket's share.
    over = [r["slot"] for r in load.where(F.col("n") * (2 * buckets) > total).select("slot").collect()]
    hot = np.zeros(slots, bool)
    hot[over] = True

    def sent(batches):
        for ids, crcs, lines in chunks(batches, CHUNK_WORDS):
            rows = list(packs(ids, crcs, lines, hot, buckets))
            yield [b for b, _ in rows], [d for _, d in rows]

    packed = map_rows(docs, "bucket int, pack binary", sent)
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != bucket and held:
                    yield _batch(repeats(held))
                    held = []
                bucket = b
                held.append(data.as_py())
        if held:
            yield _batch(repeats(held))

    return dealt.mapInArrow(found, "doc long, crc long, start int, stop int")


def _batch(columns) -> pa.RecordBatch:
    doc, crc, start, stop = columns
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(crc, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())],
        ["doc", "crc", "start", "stop"],
    )


def dedup(
    docs: DataFrame, buckets: int | None = None, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and ``kept``, the words that stay, joined by a blank.

    ``buckets`` is the number of groups the windows are dealt to, by default four per shuffle partition; ``slots`` should
    be at least sixteen times as many.
    """
    spark = docs.sparkSession
    rows = pick(docs, _id=id_col, _text=text_col).select(F.col("_id").cast("long").alias("_id"), "_text")
    buckets = buckets or BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = _spans(rows, buckets, slots)
    removed = spans.groupBy("doc", "crc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    text = F.coalesce("_text", F.lit(""))
    # The same key as ``text_key``: Spark's xxhash64 is XXH64 with seed 42.
    key = F.shiftleft(F.crc32(text), 31).bitwiseOR(F.shiftrightunsigned(F.xxhash64(text), 33))
    keyed = rows.withColumn("doc", F.coalesce("_id", F.lit(_NULL_ID))).withColumn("crc", key)
    marked = keyed.join(removed, ["doc", "crc"], "left").select("_id", "_text", "spans")

    def kept(batches):
        for ids, texts, spans_ in batches:
            out = []
            for doc, text, spans in zip(ids, texts, spans_):
                words = blank_words(text)
                stay = without(words, [(s["start"], s["stop"]) for s in spans]) if spans else words
                line = b" ".join(stay)
                out.append((doc, len(words), len(words) - len(stay), hashlib.sha256(line).hexdigest(), line.decode("utf-8", "surrogatepass")))
            yield tuple(zip(*out)) if out else ((),) * 5

    return map_rows(marked, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", kept)


def without(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for start, stop in sorted(spans):
        if start > at:
            out += words[at:start]
        at = max(at, stop)
    return out + words[at:]
