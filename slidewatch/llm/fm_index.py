"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a run of whole documents of about ``shard_words`` words (a longer document is cut into pieces that overlap by a
window, a shard each, and their spans are merged). Its words become numbers, with a separator of its own after each piece, and

* the suffix order comes from prefix doubling on packed sort keys, only ties being sorted again;
* the Burrows-Wheeler column goes into a wavelet matrix, whose levels answer rank queries for many symbols at once;
* all benchmark windows are searched backward together, and drop out as their row range gets empty;
* row ranges are turned into places through positions sampled at every ``SAMPLED``-th word, walking back from the others;
* places are marked with their window's length and merged into spans to remove.

The benchmark is a stated query set. It is read in blocks of about ``block_words`` words. With more than one, each is searched
in all texts and its hits are written before the next one is read, so what driver and tasks hold does not grow with it. Words lower A-Z and are runs of characters other than ASCII non-alphanumerics.

Defined results: null and empty texts have no words and no hits; a null doc_id stays; items without words have no window;
items with a null id count as one with the name "null"; equal items all count; repeated rows give repeated results; empty
tables give no hits or no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidewatch.llm.common import folded_words, map_rows, packed, pick
from slidewatch.session import work_path

WINDOW = 10
SHARD_WORDS = 1 << 17
BLOCK_WORDS = 1 << 20
SAMPLED = 16

_INDEX = 20
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start of each suffix, in order. The last symbol must occur once; at most 2**20 symbols."""
    n = len(symbols)
    if n > 1 << _INDEX:
        raise ValueError("a shard has at most 2**20 symbols")
    places = np.arange(n, dtype=np.int64)
    keys = np.sort((symbols.astype(np.int64) << _INDEX) | places)
    order = keys & ((1 << _INDEX) - 1)
    rank = np.empty(n, np.int64)

    def heads(upper: np.ndarray) -> np.ndarray:
        new = np.empty(len(upper), bool)
        new[:1] = True
        np.not_equal(upper[1:], upper[:-1], out=new[1:])
        return new

    new = heads(keys >> _INDEX)
    rank[order] = np.maximum.accumulate(np.where(new, places, 0))
    width = 1
    slots = places
    tied = _tied(new)
    while tied.any():
        slots = slots[tied]
        members = order[slots]
        ahead = rank[np.minimum(members + width, n - 1)]
        keys = np.sort((rank[members] << 2 * _INDEX) | (ahead << _INDEX) | members)
        members = keys & ((1 << _INDEX) - 1)
        order[slots] = members
        new = heads(keys >> _INDEX)
        rank[members] = np.maximum.accumulate(np.where(new, slots, 0))
        tied = _tied(new)
        width *= 2
    return order


def _tied(new: np.ndarray) -> np.ndarray:
    """Members of groups of two or more, from the marks of group heads."""
    return ~(new & np.append(new[1:], True))


class WaveletMatrix:
    """Rank of any symbol before any place, for arrays of both."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for bit in range(bits - 1, -1, -1):
            flags = (symbols >> bit) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(flags, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            order = flags.astype(bool)
            symbols = np.concatenate([symbols[~order], symbols[order]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Occurrences of ``symbol[k]`` before each ``place[k]``."""
        found = [np.zeros(len(symbol), np.int64), *places]
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            up = ((symbol >> bit) & 1).astype(bool)
            for k, at in enumerate(found):
                passed = ones[at]
                found[k] = np.where(up, zeros + passed, at - passed)
        return [at - found[0] for at in found[1:]]


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n = len(symbols)
        order = suffix_order(symbols)
        self.column = symbols[order - 1]  # the place before the first is the last
        self.tree = WaveletMatrix(self.column, max(1, int(n_symbols - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        kept = order % SAMPLED == 0
        self.sampled = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range [low, high) of each pattern (rows of symbols, filled up at the end)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - step]
            a, b = self.tree.rank(symbol, low[live], high[live])
            low[live] = self.first[symbol] + a
            high[live] = self.first[symbol] + b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Start of the suffix in each row."""
        out = np.empty(len(rows), np.int64)
        todo, walked = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            at = rows[todo]
            hit = self.sampled[at + 1] > self.sampled[at]
            out[todo[hit]] = self.positions[self.sampled[at[hit]]] + walked
            todo = todo[~hit]
            at = at[~hit]
            symbol = self.column[at]
            (before,) = self.tree.rank(symbol, at)
            rows[todo] = self.first[symbol] + before
            walked += 1
        return out


class Phrases:
    """Distinct windows of benchmark items, as tuples of words, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for name, text in items:
            words = folded_words(text)
            for at in range(max(1, len(words) - window + 1) if words else 0):
                found[tuple(words[at : at + window])].add(name)
        self.windows = list(found)
        self.items = [sorted(v) for v in found.values()]
        self.longest = max(map(len, self.windows), default=0)

    def numbered(self, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose words all occur: their numbers, as rows of symbols, and their lengths."""
        own = [k for k, w in enumerate(self.windows) if all(map(vocabulary.__contains__, w))]
        rows = np.zeros((len(own), max(1, self.longest)), np.int64)
        for r, k in enumerate(own):
            rows[r, : len(self.windows[k])] = [vocabulary[w] for w in self.windows[k]]
        return np.array(own, np.int64), rows, np.array([len(self.windows[k]) for k in own], np.int64)


def search_shard(texts: list[list[bytes]], phrases: Phrases, shard_words: int) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """Of each document: merged spans [start, stop) of words to remove, and the items found."""
    overlap = max(0, phrases.longest - 1)
    # A piece and its separator fit an index by themselves, whatever ``shard_words`` says.
    step = max(1, min(shard_words, (1 << _INDEX) - overlap - 1))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    held, size = [], 0
    for doc, words in enumerate(texts):
        for at in range(0, len(words), step):
            piece = words[at : at + step + overlap]
            if held and size + len(piece) + 1 > step + overlap + 1:
                _search_pieces(held, phrases, spans, items)
                held, size = [], 0
            held.append((doc, at, piece))
            size += len(piece) + 1
    _search_pieces(held, phrases, spans, items)
    return [(merged(s), sorted(i)) for s, i in zip(spans, items)]


def _search_pieces(
    pieces: list[tuple[int, int, list[bytes]]], phrases: Phrases, spans: list[list[tuple[int, int]]], items: list[set[str]]
) -> None:
    """Searches one index over ``pieces`` (document, place, words); adds to the documents' spans and items."""
    if not pieces or not phrases.windows:
        return
    vocabulary: dict[bytes, int] = defaultdict(count(len(pieces)).__next__)
    parts, starts, total = [], [], 0
    for k, (_, _, words) in enumerate(pieces):
        parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([k], np.int64))
        starts.append(total)
        total += len(words) + 1
    own, rows, lengths = phrases.numbered(vocabulary)
    if not len(own):
        return
    index = FMIndex(np.concatenate(parts), len(pieces) + len(vocabulary))
    low, high = index.search(rows, lengths)
    hit = np.flatnonzero(high > low)
    sizes = (high - low)[hit]
    which = np.repeat(hit, sizes)
    offsets = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = index.locate(low[which] + offsets)
    piece = np.searchsorted(np.array(starts), places, side="right") - 1
    for p, w, at in zip(piece.tolist(), which.tolist(), places.tolist()):
        doc, base, _ = pieces[p]
        begin = base + at - starts[p]
        spans[doc].append((begin, begin + int(lengths[w])))
        items[doc].update(phrases.items[own[w]])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges; touching ones become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _groups(batches, shard_words: int):
    """Runs of documents (id, words) with about ``shard_words`` words."""
    held, size = [], 0
    for ids, texts in batches:
        for doc, text in zip(ids, texts):
            words = folded_words(text)
            if held and size + len(words) > shard_words:
                yield held
                held, size = [], 0
            held.append((doc, words))
            size += len(words) + 1
    if held:
        yield held


def _blocks(benchmark: DataFrame, window: int, block_words: int, item_col: str, text_col: str) -> tuple[int, Callable[[int], Phrases]]:
    """The benchmark in parts of about ``block_words`` words: their number, at least one, and what reads one of them."""
    rows = pick(benchmark, item=item_col, text=text_col).select(
        F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("item"), "text"
    )
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // (4 * block_words)))

    def block(k: int) -> Phrases:
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        return Phrases([(r["item"], r["text"]) for r in part.collect()], window)

    return parts, block


_SPANS = "spans array<struct<start:long,stop:long>>"


def _text_key(column) -> list:
    """Two hashes that stand for a text; null is no text."""
    text = F.coalesce(column, F.lit(""))
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2")]


def _found(docs: DataFrame, parts: int, block: Callable[[int], Phrases], shard_words: int, text_col: str) -> DataFrame:
    """_h1, _h2, items and spans of each text that a block hits, with all blocks merged.

    Driver and tasks hold one block at a time: its hits are written before the next one is read.
    """
    spark = docs.sparkSession
    rows = pick(docs, _text=text_col).select(*_text_key(F.col("_text")), "_text")
    paths = []
    for k in range(parts):
        phrases = spark.sparkContext.broadcast(block(k))

        def searched(batches, phrases=phrases):
            for group in _groups(((list(zip(a, b)), texts) for a, b, texts in batches), shard_words):
                hit = search_shard([words for _, words in group], phrases.value, shard_words)
                out = [(*key, i, [{"start": a, "stop": b} for a, b in s]) for (key, _), (s, i) in zip(group, hit) if s]
                yield tuple(zip(*out)) if out else ((),) * 4

        paths.append(work_path(spark, "benchmark_hits"))
        map_rows(rows, f"_h1 long, _h2 long, items array<string>, {_SPANS}", searched).write.parquet(paths[-1])
        phrases.unpersist()
    # A text that is there many times has the same hits each time, so its lists stay as long as one text's.
    every = spark.read.parquet(*paths).distinct().groupBy("_h1", "_h2")
    return every.agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))


def _result(doc: int | None, n_words: int, spans: list[tuple[int, int]], items: list[str]) -> tuple:
    n_hit = sum(b - a for a, b in spans)
    return (
        doc, n_words, n_hit, len(items), items, hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0,
        [{"start": a, "stop": b} for a, b in spans],
    )


def hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated and the merged ``spans``."""
    spark = docs.sparkSession
    rows = pick(docs, _id=id_col, _text=text_col).selectExpr("cast(_id as long)", "_text")
    schema = f"doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, {_SPANS}"
    parts, block = _blocks(benchmark, window, block_words, item_col, item_text_col)
    if parts > 1:
        counted = map_rows(
            rows.select("_id", *_text_key(F.col("_text")), "_text"), "_id long, _h1 long, _h2 long, n_words long",
            lambda batches: ((ids, a, b, [len(folded_words(t)) for t in texts]) for ids, a, b, texts in batches),
        )
        found = counted.join(_found(docs, parts, block, shard_words, text_col), ["_h1", "_h2"], "left")

        def merge(batches):
            for ids, counts, items, spans in batches:
                out = []
                for doc, n_words, i, s in zip(ids, counts, items, spans):
                    out.append(_result(doc, n_words, merged([(x["start"], x["stop"]) for x in s or []]), sorted(set(i or []))))
                yield tuple(zip(*out)) if out else ((),) * 8

        return map_rows(found.select("_id", "n_words", "items", "spans"), schema, merge)
    phrases = spark.sparkContext.broadcast(block(0))

    def searched(batches):
        for group in _groups(batches, shard_words):
            found = search_shard([words for _, words in group], phrases.value, shard_words)
            yield tuple(zip(*[_result(doc, len(words), s, i) for (doc, words), (s, i) in zip(group, found)]))

    return map_rows(rows, schema, searched)


def without_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns."""
    spark = docs.sparkSession
    parts, block = _blocks(benchmark, window, block_words, item_col, item_text_col)
    if parts > 1:
        found = _found(docs, parts, block, shard_words, text_col).select("_h1", "_h2")
        keyed = packed(docs).select("_row", *_text_key(F.col("_row")[text_col]))
        return keyed.join(found, ["_h1", "_h2"], "left_anti").select("_row.*")
    place = docs.columns.index(text_col)
    phrases = spark.sparkContext.broadcast(block(0))

    def cleaned(batches):
        for batch in batches:
            column = batch.column(place)
            held, size = [], 0
            clean = []
            for text in column.to_pylist():
                words = folded_words(text)
                if held and size + len(words) > shard_words:
                    clean += _clean(held, phrases.value, shard_words)
                    held, size = [], 0
                held.append(words)
                size += len(words) + 1
            clean += _clean(held, phrases.value, shard_words) if held else []
            yield batch.filter(_mask(clean))

    return docs.mapInArrow(cleaned, docs.schema)


def _clean(texts: list[list[bytes]], phrases: Phrases, shard_words: int) -> list[bool]:
    return [not spans for spans, _ in search_shard(texts, phrases, shard_words)]


def _mask(keep: list[bool]):
    import pyarrow as pa

    return pa.array(keep, pa.bool_())


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``, from the first word's start to the last one's end."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join([*out, text[at:]])
