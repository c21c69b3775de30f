"""SimHash near-duplicates with BK-trees.

A fingerprint bit is the majority of that bit over the XXH64 values of a text's word shingles. Two texts are linked when
their fingerprints differ in at most ``radius`` bits, and a component is all that links reach.

* Equal fingerprints are one node, so thousands of copies of a text cost one.
* Fingerprints are dealt to buckets by ``radius + 1`` bit blocks: two within the radius agree in one block. Each bucket is
  a shard that builds a BK-tree (children keyed by their Hamming distance to the parent) and searches it along the edges
  within the radius only. A tree goes by shuffle to the task that holds its bucket: a broadcast of the trees of all
  documents has no size bound.
* A bucket with more than ``tree_limit`` fingerprints is dealt again by another cut of the 64 bits into as many blocks, and the
  shards of those build the trees. Blocks are cut into parts, and those into smaller parts, so after four cuts (radius 2) a bucket's
  fingerprints agree in all but 16 bits at most, and in most buckets in all but 13: that many fingerprints a tree can hold, however
  hot the bucket was.
* A bucket passes on a star per local component. Stars are contracted by alternating large-star and small-star rounds
  until nothing changes, each round checkpointed in the shared folder.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a null doc_id is given a
component but names none, unless a component has only null ids; repeated rows give repeated results; other columns are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidewatch.llm.common import as_key, blank_words, map_rows, packed, pick
from slidewatch.session import work_path, work_root

SEED = 42
#: Shingles hashed at once, a bound of a task's memory.
HASHED = 100_000
TREE_LIMIT = 4096


def shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    if len(words) < size:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[k:] for k in range(size))))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text; zero without words."""
    # bytes.lower lowers A-Z alone.
    words = [*map(bytes.lower, blank_words(text))]
    if not words:
        return 0
    total, counts = 0, np.zeros(64, np.int64)
    for at in range(0, max(1, len(words) - size + 1), HASHED):
        part = shingles(words[at : at + HASHED + size - 1], size)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64)
        total += len(hashes)
        counts += _bit_counts(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def hashed(batches):
        for ids, texts in batches:
            yield ids, [_signed(fingerprint(t, size)) for t in texts]

    rows = pick(docs, _id=id_col, _text=text_col).selectExpr("cast(_id as long)", "_text")
    return map_rows(rows, "doc_id long, fp long", hashed)


class BKTree:
    """A metric tree over 64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return
        node = 0
        while True:
            distance = (self.values[node] ^ value).bit_count()
            if not distance:
                return
            child = self.children[node].get(distance)
            if child is None:
                self.children[node][distance] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(self.values[node])
            children = self.children[node]
            if children:
                todo += [c for edge, c in children.items() if distance - radius <= edge <= distance + radius]
        return found


def bucket_stars(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its component) within one bucket, for all but the smallest."""
    parent = {v: v for v in values}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    tree = BKTree()
    for v in parent:
        for near in tree.within(v, radius):
            a, b = root(v), root(near)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, root(v)) for v in parent if root(v) != v]


def cuts(radius: int) -> list[list[int]]:
    """Masks of the blocks of each cut: the k-th cut puts bits together that have the same k-th digit of their place."""
    parts, masks = [range(64)], []
    while len(parts[0]) > 1:
        smaller, blocks = [], [0] * (radius + 1)
        for part in parts:
            edges = [part.start + -(-k * len(part) // (radius + 1)) for k in range(radius + 2)]
            for digit, own in enumerate(range(a, b) for a, b in zip(edges, edges[1:])):
                blocks[digit] |= sum(1 << bit for bit in own)
                smaller.append(own)
        masks.append(blocks)
        parts = sorted((p for p in smaller if p), key=len, reverse=True)
    return masks


def links(distinct: DataFrame, radius: int = 2, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``distinct.fp`` within ``radius`` bits."""
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    spark = distinct.sparkSession

    def grown(batches):
        held, values = None, []
        for keys, fps in batches:
            out: list[tuple[int, int]] = []
            for key, fp in zip(keys, fps):
                if key != held:
                    out += bucket_stars([v & 0xFFFFFFFFFFFFFFFF for v in values], radius)
                    held, values = key, []
                values.append(fp)
            yield _columns(out)
        yield _columns(bucket_stars([v & 0xFFFFFFFFFFFFFFFF for v in values], radius))

    found, todo = None, distinct.select("fp", F.expr("cast(array() as array<bigint>)").alias("key"))
    for level, masks in enumerate(cuts(radius)):
        blocks = [F.array(F.lit(k).cast("long"), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)]
        dealt = todo.select("fp", F.col("key").alias("_key"), F.explode(F.array(*blocks)).alias("_block"))
        dealt = dealt.select("fp", F.concat("_key", "_block").alias("key"))
        sizes = dealt.groupBy("key").count().where("count > 1")
        path = work_path(spark, "simhash_buckets")
        dealt.join(sizes, "key").write.parquet(path)
        shared = spark.read.parquet(path)
        last = level == len(cuts(radius)) - 1
        trees = (shared if last else shared.where(F.col("count") <= tree_limit)).select("key", "fp")
        trees = trees.repartition("key").sortWithinPartitions("key", "fp")
        edges = map_rows(trees, "a long, b long", grown, rows=4096)
        found = edges if found is None else found.unionByName(edges)
        todo = shared.where(F.col("count") > tree_limit)
        if last or not todo.take(1):
            return found


def _columns(pairs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    return [_signed(a) for a, _ in pairs], [_signed(b) for _, b in pairs]


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that links reach."""
    spark = edges.sparkSession
    work_root(spark)
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    state = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("m", "a").alias("m"))
        large = both.join(least, both.a == least.node).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct().checkpoint()
        lower = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
        small = large.join(lower, large.a == lower.node)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(lower.select("node", "m"))
        pairs = small.distinct().checkpoint()
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    roots = pairs.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root"), F.col("root")).distinct())


def components(
    docs: DataFrame, size: int = 3, radius: int = 2, tree_limit: int = TREE_LIMIT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach."""
    spark = docs.sparkSession
    path = work_path(spark, "simhash_fingerprints")
    fingerprints(docs, size, id_col, text_col).write.parquet(path)
    marked = spark.read.parquet(path)
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    path = work_path(spark, "simhash_distinct")
    first.write.parquet(path)
    first = spark.read.parquet(path)
    roots = connected(links(first.select("fp"), radius, tree_limit))
    named = first.join(roots, first.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    path = work_path(spark, "simhash_components")
    named.join(ids, "root").select("fp", "component_id").write.parquet(path)
    labels = spark.read.parquet(path)
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, size: int = 3, radius: int = 2, tree_limit: int = TREE_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when near copies go: of each component the one with the least doc_id (null last).

    Of rows with that doc_id in one component the one with the least hash of its text stays, of equal rows one. Texts without
    words are one group, as their fingerprints are equal.
    """
    spark = docs.sparkSession

    def hashed(batches):
        for ids, hashes, texts in batches:
            yield ids, hashes, [_signed(fingerprint(t, size)) for t in texts]

    rows = pick(docs, _id=id_col, _text=text_col).select(
        F.col("_id").cast("long"), F.xxhash64(F.coalesce("_text", F.lit(""))), "_text"
    )
    marked = map_rows(rows, "id long, text long, fp long", hashed)
    first = marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text")).alias("first"))
    path = work_path(spark, "near_copies")
    first.write.parquet(path)
    first = spark.read.parquet(path)
    roots = connected(links(first.select("fp"), radius, tree_limit)).withColumnRenamed("node", "a")
    named = first.join(roots, F.col("fp") == F.col("a"), "left").select("first", F.coalesce("root", "fp").alias("root"))
    stay = named.groupBy("root").agg(F.min("first").alias("stays"))
    path = work_path(spark, "near_copies_kept")
    stay.select(as_key(F.col("stays.id")).alias("_key"), F.col("stays.text").alias("_hash")).write.parquet(path)
    stay = spark.read.parquet(path)
    keyed = packed(docs).select(
        "_row", as_key(F.col("_row")[id_col].cast("long")).alias("_key"),
        F.xxhash64(F.coalesce(F.col("_row")[text_col], F.lit(""))).alias("_hash"),
    )
    return keyed.join(stay, ["_key", "_hash"], "left_semi").dropDuplicates(["_key", "_hash"]).select("_row.*")


def fingerprint_text(column: str = "fp"):
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
