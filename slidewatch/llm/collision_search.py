"""Nearest neighbours by collision counting over single random projections.

A vector is projected on ``projections`` random lines. Each projection is a sorted array, and a vector collides with a query
on a line when it lies in the window around the query's own projection. A vector at distance R falls into a window of half
width R with one fixed probability, whatever the data, so one threshold on the number of collisions finds all vectors
within R with a stated chance (``CHANCE`` each). Virtual rehashing: windows start narrow and are widened about the query, and only the
ring that is new is counted, until the k-th best vector verified lies within R. Vectors whose count reaches the threshold are
verified: their inner product is computed in double precision from the original components.

Largest inner product becomes nearest by one further component: vectors are scaled by the greatest norm M and given
``sqrt(1 - |x/M|^2)``, queries are scaled to length one and given 0; then distance^2 = 2 - 2 <q, x> / (M |q|).

* A task cuts its rows into runs of at most ``RUN`` rows. In a run every sorted array is marked at ``CELLS`` places, and for
  each mark a bitmap has the rows before it. A window is the difference of two bitmaps, its ends moved outward to the next
  marks, and collisions of 64 rows at a time are added in bit-sliced counters.
* Queries go out in blocks of a bounded size, each against all rows. Rows are dealt to levels of growing size; a level
  starts with the k-th best score that the levels before have found, so it looks no further than that and passes on only
  what is better. So what is shuffled does not grow with the number of tasks: some ``k * RATIO`` rows a query and level.
* Every row is in the index, nothing is capped: a window that has grown over the whole distance verifies all rows of the run.

The answer is approximate in one way only: a true neighbour is missed with at most the chance 1 - CHANCE, whatever its level.
Scores are exact, ties go to the smaller id.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part. A query searches the
vectors of its own length. Rows of the query's own id are no candidates, so repeated rows do not find each other, and a query
that is repeated with the same vector is asked once; with different vectors under one id each is asked. Other rows that repeat
are candidates each. A null id is no query; as a candidate it comes last among ties. An empty table gives no rows; other
columns are not looked at. Ids are read as long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidewatch.llm.common import pick
from slidewatch.llm.vectors import BLOCK_BYTES, best_rows, block_count, finite, ids_of, matrix, runs_of
from slidewatch.session import work_path

PROJECTIONS = 256
#: Chance that a vector within the radius reaches the collision threshold.
CHANCE = 0.95
#: Rows of a run and marks of a sorted array; its bitmaps take PROJECTIONS * CELLS * RUN / 8 bytes.
RUN = 16_384
CELLS = 128
#: Queries whose counters a task holds at once.
TOGETHER = 64
#: First radius of a search that knows nothing, and how it grows.
FIRST, GROWS = 0.5, 1.5
#: Rows of the first level, and how levels grow.
LEVEL_ROWS, RATIO = 4096, 16


def threshold(projections: int, chance: float) -> int:
    """The most collisions that a vector at the edge of the window's radius reaches with ``chance``."""
    p = erf(1 / sqrt(2))
    tail, at = 0.0, projections + 1
    while tail < chance:
        at -= 1
        tail += comb(projections, at) * p**at * (1 - p) ** (projections - at)
    return at


@lru_cache(maxsize=4)
def lines(dim: int, projections: int, seed: int) -> np.ndarray:
    """Random directions, the same in every task; the last row belongs to the added component."""
    return np.random.default_rng(seed).standard_normal((dim + 1, projections))


class Counters:
    """Bit-sliced sums of bitmaps: plane k holds bit k of the count of every row. Two bitmaps are added at a time."""

    def __init__(self, shape: tuple[int, int], most: int):
        self.planes = [np.zeros(shape, np.uint64) for _ in range(most.bit_length())]
        self.waiting: list[np.ndarray | None] = [None] * len(self.planes)

    def add(self, bits: np.ndarray, level: int = 0) -> None:
        while level < len(self.planes):
            other, plane = self.waiting[level], self.planes[level]
            if other is None:
                self.waiting[level] = bits
                return
            self.waiting[level] = None
            either = bits ^ other
            carry = (bits & other) | (plane & either)
            plane ^= either
            bits, level = carry, level + 1

    def reach(self, least: int) -> np.ndarray:
        """Bitmap of the rows counted at least ``least`` times."""
        for level, bits in enumerate(self.waiting):
            if bits is not None:
                self.waiting[level] = None
                for plane in self.planes[level:]:
                    bits, carry = plane & bits, bits
                    plane ^= carry
        more, same = np.zeros_like(self.planes[0]), ~np.zeros_like(self.planes[0])
        for level in reversed(range(len(self.planes))):
            if least >> level & 1:
                same &= self.planes[level]
            else:
                more |= same & self.planes[level]
                same &= ~self.planes[level]
        return more | same

    def keep(self, which: np.ndarray) -> None:
        self.planes = [p[which] for p in self.planes]


class Run:
    """The sorted projections of one run of rows."""

    def __init__(self, vectors: np.ndarray, greatest: float, directions: np.ndarray):
        scaled = vectors / greatest
        added = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
        projected = scaled @ directions[:-1] + added[:, None] * directions[-1]
        n, m = projected.shape
        self.n, self.words = n, -(-n // 64)
        cells = min(CELLS, n)
        marks = np.arange(cells + 1) * n // cells
        # Of each sorted array, the first and last value between two marks, and the rows before each mark.
        self.first, self.last = np.empty((m, cells)), np.empty((m, cells))
        self.prefix = np.zeros((m, cells + 1, self.words), np.uint64)
        cell_of = np.repeat(np.arange(cells), np.diff(marks))
        for j in range(m):
            order = np.argsort(projected[:, j], kind="stable")
            self.first[j], self.last[j] = projected[order[marks[:-1]], j], projected[order[marks[1:] - 1], j]
            inside = np.zeros((cells, self.words * 64), np.uint8)
            inside[cell_of, order] = 1
            bits = np.packbits(inside, axis=1, bitorder="little").view(np.uint64)
            np.bitwise_or.accumulate(bits, axis=0, out=self.prefix[j, 1:])

    def windows(self, centres: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks (first, last) around the windows of each query on each line, moved outward; shape (lines, queries)."""
        low, high = np.empty(centres.T.shape, np.int64), np.empty(centres.T.shape, np.int64)
        under, over = (centres - half[:, None]).T, (centres + half[:, None]).T
        for j in range(len(low)):
            low[j] = self.last[j].searchsorted(under[j], "left")
            high[j] = self.first[j].searchsorted(over[j], "right")
        return low, np.maximum(low, high)


class Best:
    """The k best rows of every query so far, and the score below which nothing matters."""

    def __init__(self, bound: np.ndarray, k: int):
        self.bound, self.k = bound, k
        self.score = np.full((len(bound), k), -np.inf)
        self.id = np.zeros((len(bound), k), np.int64)
        self.null = np.zeros((len(bound), k), bool)

    def least(self) -> np.ndarray:
        return np.maximum(self.bound, self.score[:, -1])

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least()[query]
        query, score, ids, null = query[good], score[good], ids[good], null[good]
        if not len(query):
            return
        held = np.unique(query)
        query = np.r_[query, np.repeat(held, self.k)]
        score, ids = np.r_[score, self.score[held].ravel()], np.r_[ids, self.id[held].ravel()]
        null = np.r_[null, self.null[held].ravel()]
        order = best_rows(query, score, null, ids, self.k)
        shape = (len(held), self.k)
        self.score[held], self.id[held], self.null[held] = score[order].reshape(shape), ids[order].reshape(shape), null[order].reshape(shape)


def search(run: Run, vectors: np.ndarray, ids: np.ndarray, null: np.ndarray, queries: np.ndarray, own: np.ndarray, best: Best,
           at: np.ndarray, greatest: float, directions: np.ndarray, least: int) -> int:
    """Looks up the queries ``at`` in one run; returns how many vectors were verified."""
    norms = np.sqrt(np.einsum("ij,ij->i", queries[at], queries[at]))
    centres = (queries[at] / norms[:, None]) @ directions[:-1]
    reach = greatest * norms
    radius_of = lambda score, reach: np.sqrt(np.maximum(0.0, 2 - 2 * np.minimum(score / reach, 1.0)))
    known = np.where(np.isfinite(best.bound[at]) | np.isfinite(best.score[at, -1]), radius_of(best.least()[at], reach), np.inf)
    radius = np.where(np.isfinite(known), known, FIRST)
    counters = Counters((len(at), run.words), run.prefix.shape[0])
    done = np.zeros((len(at), run.words), np.uint64)
    everything = np.packbits(np.arange(run.words * 64) < run.n, bitorder="little").view(np.uint64)
    low = high = None
    verified = 0
    while len(at):
        new_low, new_high = run.windows(centres, radius)
        if low is not None:
            new_low, new_high = np.minimum(low, new_low), np.maximum(high, new_high)
        for j, prefix in enumerate(run.prefix):
            ring = prefix[new_high[j]] ^ prefix[new_low[j]]
            if low is not None:
                ring ^= prefix[high[j]] ^ prefix[low[j]]
            counters.add(ring)
        low, high = new_low, new_high
        reached = counters.reach(least)
        reached[radius >= 2] = everything
        fresh = reached & ~done
        done |= reached
        verified += _verify(fresh, vectors, ids, null, queries, own, best, at)
        # The k-th best lies within the radius, or the radius is all there is.
        bound = best.least()[at]
        open_ = (radius < 2) & ~(bound >= (1 - radius**2 / 2) * reach)
        wider = np.where(np.isfinite(bound), radius_of(bound, reach), np.inf)
        radius = np.minimum(np.maximum(radius * GROWS, radius + 1e-9), np.maximum(wider, radius * (1 + 1e-9)))[open_]
        at, centres, reach, done = at[open_], centres[open_], reach[open_], done[open_]
        low, high = low[:, open_], high[:, open_]
        counters.keep(open_)
    return verified


def _verify(fresh, vectors, ids, null, queries, own, best, at) -> int:
    """Exact scores of the rows marked for each query; only those that reach its k-th best go on."""
    least, asked, rows, scores, total = best.least()[at], [], [], [], 0
    for bits, query, bound in zip(np.unpackbits(fresh.view(np.uint8), axis=1, bitorder="little"), at, least):
        marked = np.flatnonzero(bits)
        total += len(marked)
        score = np.einsum("ij,j->i", vectors[marked], queries[query])
        good = score >= bound
        rows.append(marked[good])
        scores.append(score[good])
        asked.append(np.full(len(rows[-1]), query))
    q, r, score = np.concatenate(asked), np.concatenate(rows), np.concatenate(scores)
    other = (ids[r] != own[q]) | null[r]
    q, r, score = q[other], r[other], score[other]
    best.add(q, score, ids[r], null[r])
    return total


def _searcher(queries, own, bound, greatest: float, k: int, projections: int, chance: float, seed: int):
    """The task's function: rows (vec_id, vector) of one length to (query, vec_id, score), k a query at most."""
    least, dim = threshold(projections, chance), queries.shape[1]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, best = lines(dim, projections, seed), Best(bound, k)
        for table in runs_of(batches, RUN):
            vectors = matrix(table.column("vector"), dim)
            ids, null = ids_of(table.column("vec_id").combine_chunks())
            run = Run(vectors, greatest, directions)
            for start in range(0, len(queries), TOGETHER):
                at = np.arange(start, min(start + TOGETHER, len(queries)))
                search(run, vectors, ids, null, queries, own, best, at, greatest, directions, least)
        query, place = np.nonzero(best.score > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(query, pa.int64()), pa.array(best.id[query, place], pa.int64(), mask=best.null[query, place]),
                pa.array(best.score[query, place]),
            ],
            ["query", "vec_id", "score"],
        )

    return found


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    rows: DataFrame, every: int = 20, k: int = 20, projections: int = PROJECTIONS, chance: float = CHANCE, seed: int = 42,
    level_rows: int = LEVEL_ROWS, block_bytes: int = BLOCK_BYTES, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows of every row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    valid = pick(rows, _id=id_col, _vector=vector_col).select(
        F.col("_id").cast("long").alias("vec_id"), F.col("_vector").cast("array<double>").alias("vector")
    ).where(finite("vector") & F.exists("vector", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    is_query = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    facts = valid.select(F.size("vector").alias("dim"), norm.alias("norm"), is_query.alias("query")).groupBy("dim").agg(
        F.count("*").alias("n"), F.max("norm").alias("norm"), F.count_if("query").alias("queries")
    ).collect()

    # The share of the rows up to each level: the last has all, each before one in RATIO of the next.
    most = max([f["n"] for f in facts], default=0)
    levels = 1
    while most > level_rows * RATIO ** (levels - 1):
        levels += 1
    u = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 40)) / float(1 << 40)
    level = sum((u >= float(RATIO) ** (k_ - levels + 1)).cast("int") for k_ in range(levels - 1)) if levels > 1 else F.lit(0)
    path = work_path(spark, "collision_rows")
    valid.withColumn("dim", F.size("vector")).withColumn("level", level).write.partitionBy("level").parquet(path)
    if not facts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    stored = spark.read.parquet(path)

    asked_path = work_path(spark, "collision_queries")
    asked = stored.where(is_query).select("vec_id", "vector", "dim").distinct()
    asked.withColumn("deal", F.pmod(F.xxhash64("vector", "vec_id"), F.lit(1 << 30))).write.parquet(asked_path)
    asked = spark.read.parquet(asked_path)

    answers = []
    for fact in facts:
        blocks = block_count(fact["queries"], fact["dim"], block_bytes)
        own_rows = stored.where(F.col("dim") == fact["dim"])
        for block in range(blocks if fact["queries"] else 0):
            part = asked.where((F.col("dim") == fact["dim"]) & (F.col("deal") % blocks == block)).toArrow()
            queries, (own, _) = matrix(part.column("vector"), fact["dim"]), ids_of(part.column("vec_id").combine_chunks())
            bound, found = np.full(len(own), -np.inf), None
            for number in range(levels):
                make = _searcher(queries, own, bound, fact["norm"], k, projections, chance, seed)
                hits = own_rows.where(F.col("level") == number).select("vec_id", "vector")
                # A level of few rows is read by few tasks: each gives k rows a query as long as no bound is known.
                if number < levels - 1:
                    hits = hits.coalesce(max(1, -(-level_rows * RATIO**number // RUN)))
                hits = hits.mapInArrow(make, "query long, vec_id long, score double")
                found = hits if found is None else found.unionByName(hits)
                path = work_path(spark, "collision_found")
                _ranked(found, k).write.parquet(path)
                found = spark.read.parquet(path)
                if number < levels - 1:
                    kth = found.where(F.col("rank") == k).select("query", "score").toArrow()
                    bound = bound.copy()
                    bound[kth.column("query").to_numpy()] = kth.column("score").to_numpy()
                    found = found.drop("rank")
            # Numbers of the block become ids again: one short row a query.
            names = spark.createDataFrame(pa.table({"query": pa.array(range(len(own)), pa.int64()), "query_id": pa.array(own)}))
            answers.append(found.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    if not answers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out
