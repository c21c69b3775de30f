"""Hard negatives by best-first search in STR-packed R-trees.

For each anchor the positives are its best rows of the same label, by integer inner product. For each positive the hard
negatives are the best rows of another label whose score lies in a window below the positive's.

Each task packs its rows, in runs of at most ``RUN``, into R-trees: rows are sorted and tiled by one coordinate after the
other (sort-tile-recursive) into pages of ``PAGE`` rows, labels kept together, and ``FAN`` pages or nodes at a time get a parent.
A node keeps the least and greatest value of each coordinate, so the inner product of an anchor with anything inside lies
between the sum of the lesser and the sum of the greater products per coordinate. A queue gives the node with the greatest upper end
first; a node is dropped when its interval lies outside the score windows, when its labels cannot serve, or when its upper
end is strictly below the score that is still needed. Equal scores are never dropped, as ties go by id.

Anchors go out in blocks of a bounded size, each against all rows, twice: for the positives, and, with the score windows that
these give, for the negatives. A task passes on at most ``per_anchor`` positives an anchor, and the rows that are among the
first of a window there. One row an anchor and candidate is shuffled, and a window by anchor ends the work.

Scores are exact: components are integers, and sums of products below 2**53 are exact in double precision. Larger components
are multiplied as Python's integers; a score beyond 64 bits raises OverflowError.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. An empty or zero
vector has score 0 with every vector of its length. An anchor meets rows of its own length only. Rows of the anchor's own id
are not its positives; repeated rows are rows of their own otherwise, and equal anchors (id, label, vector) are one anchor. A
null id is no anchor, keeps its label, and comes last among ties. An anchor without positives, or a positive without negatives
in its window, gives no rows. An empty table gives no rows; other columns are not looked at. Ids and labels are read as long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidewatch.llm.common import pick
from slidewatch.llm.vectors import BLOCK_BYTES, block_count, finite, ids_of, matrix, runs_of
from slidewatch.session import work_path

RUN, PAGE, FAN = 32_768, 64, 16
#: Anchors whose node intervals a task holds at once.
TOGETHER = 256


def _tiles(coordinates: np.ndarray, rows: np.ndarray, axis: int, page: int) -> Iterator[np.ndarray]:
    """Pages of ``rows`` by sort-tile-recursive packing from ``axis`` on."""
    pages, left = -(-len(rows) // page), coordinates.shape[1] - axis
    if pages <= 1:
        yield rows
        return
    slabs = int(np.ceil(pages ** (1 / left) - 1e-9)) if left > 1 else pages
    if left:
        rows = rows[np.argsort(coordinates[rows, axis], kind="stable")]
    size = page * -(-pages // max(2, slabs))
    for at in range(0, len(rows), size):
        yield from _tiles(coordinates, rows[at : at + size], axis + 1, page) if left else [rows[at : at + size]]


def str_pages(coordinates: np.ndarray, labels: np.ndarray, page: int = PAGE) -> list[np.ndarray]:
    """Pages of rows; a page has one label, or several that have fewer rows than a page together."""
    order = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    pages, small = [], []
    for group in np.split(order, cuts):
        if len(group) >= page:
            pages += _tiles(coordinates, group, 0, page)
            continue
        if sum(map(len, small)) + len(group) > page:
            pages.append(np.concatenate(small))
            small = []
        small.append(group)
    return pages + ([np.concatenate(small)] if small else [])


class RTree:
    """Boxes over pages of rows; ``children[k]`` of a page is None, ``rows[k]`` of an inner node is None."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, page: int = PAGE, fan: int = FAN):
        pages = str_pages(vectors, labels, page)
        self.rows: list[np.ndarray | None] = list(pages)
        self.children: list[range | None] = [None] * len(pages)
        low, high = [vectors[p].min(axis=0) for p in pages], [vectors[p].max(axis=0) for p in pages]
        first, last = [labels[p].min() for p in pages], [labels[p].max() for p in pages]
        level = range(len(pages))
        while len(level) > fan:
            above = len(low)
            for at in range(level.start, level.stop, fan):
                own = range(at, min(at + fan, level.stop))
                low.append(np.min(low[own.start : own.stop], axis=0))
                high.append(np.max(high[own.start : own.stop], axis=0))
                first.append(min(first[own.start : own.stop]))
                last.append(max(last[own.start : own.stop]))
                self.rows.append(None)
                self.children.append(own)
            level = range(above, len(low))
        self.roots = level
        self.low, self.high, self.first, self.last = np.array(low), np.array(high), first, last

    def intervals(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible inner product of each query with each node."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


class Needed:
    """The first ``keep`` rows, by score and id, of one score window."""

    def __init__(self, keep: int, low: float = -np.inf, high: float = np.inf):
        self.keep, self.low, self.high = keep, low, high
        self.rows: list[tuple] = []

    def least(self):
        return self.rows[-1][-1] if len(self.rows) == self.keep else self.low

    def offer(self, score, null: bool, own_id: int) -> None:
        if self.low <= score <= self.high and score >= self.least():
            self.rows.append((-score, null, own_id, score))
            self.rows.sort()
            del self.rows[self.keep :]


def best_first(tree: RTree, low: list, high: list, vectors, labels, query, serves, usable, wanted: list[Needed], ids, null, own: int) -> int:
    """Fills ``wanted``; ``serves(first, last)`` tells whether a node's labels can, ``usable(labels)`` which rows do. Returns pages read."""
    top = max(w.high for w in wanted)
    queue = []
    read = 0

    def push(nodes: range) -> None:
        for node in nodes:
            if serves(tree.first[node], tree.last[node]) and low[node] <= top:
                heapq.heappush(queue, (-high[node], node))

    push(tree.roots)
    while queue:
        upper, node = heapq.heappop(queue)
        floor = min(w.least() for w in wanted)
        if -upper < floor:
            break
        if tree.rows[node] is None:
            push(tree.children[node])
            continue
        rows = tree.rows[node]
        read += 1
        scores = vectors[rows] @ query
        good = np.flatnonzero((scores >= floor) & (scores <= top))
        if not len(good):
            continue
        rows, scores = rows[good], scores[good]
        keep = usable(labels[rows]) & ((ids[rows] != own) | null[rows])
        for row, score in zip(rows[keep].tolist(), scores[keep].tolist()):
            for w in wanted:
                w.offer(score, bool(null[row]), int(ids[row]))
    return read


def _searcher(anchors: np.ndarray, own: np.ndarray, anchor_labels: np.ndarray, make_wanted, same: bool, exact: bool):
    """The task's function: rows (vec_id, label, vector) of one length to (anchor, vec_id, score)."""
    dim = anchors.shape[1]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [make_wanted(k) for k in range(len(anchors))]
        for table in runs_of(batches, RUN):
            vectors = matrix(table.column("vector"), dim)
            labels = table.column("label").to_numpy().astype(np.int64)
            ids, null = ids_of(table.column("vec_id").combine_chunks())
            tree = RTree(vectors, labels)
            kind = np.float64 if exact else object
            values = vectors if exact else _integers(vectors)
            for start in range(0, len(anchors), TOGETHER):
                part = anchors[start : start + TOGETHER]
                lows, highs = tree.intervals(part)
                # Sums of large numbers may round; a box is never judged better than by its rounding.
                slack = 0 if exact else 1e-9 * (np.abs(part) @ np.maximum(np.abs(tree.low), np.abs(tree.high)).T)
                lows, highs = (lows - slack).tolist(), (highs + slack).tolist()
                for k, query in enumerate(part if exact else _integers(part)):
                    at = start + k
                    if not wanted[at]:
                        continue
                    label = anchor_labels[at]
                    if same:
                        serves, usable = (lambda a, b, x=label: a <= x <= b), (lambda x, y=label: x == y)
                    else:
                        serves, usable = (lambda a, b, x=label: not a == x == b), (lambda x, y=label: x != y)
                    best_first(tree, lows[k], highs[k], values, labels, query.astype(kind), serves, usable, wanted[at], ids, null, own[at])
        anchor, names, nulls, scores = [], [], [], []
        for at, windows in enumerate(wanted):
            # A row that several windows want is passed on once; equal rows are counted by their place in one window.
            held: dict[tuple, int] = {}
            for w in windows:
                counts: dict[tuple, int] = {}
                for row in w.rows:
                    counts[row] = counts.get(row, 0) + 1
                for row, n in counts.items():
                    held[row] = max(n, held.get(row, 0))
            for (_, none, name, score), n in held.items():
                anchor += [at] * n
                names += [None if none else name] * n
                scores += [_long(score)] * n
        yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(names, pa.int64()), pa.array(scores, pa.int64())], ["anchor", "vec_id", "score"])

    return found


def _integers(values: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)


def _long(score) -> int:
    score = int(score)
    if not -(1 << 63) <= score < 1 << 63:
        raise OverflowError("a score needs more than 64 bits")
    return score


def _first(found: DataFrame, by: list[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(
    rows: DataFrame, every: int = 100, per_anchor: int = 5, per_positive: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256,
    block_bytes: int = BLOCK_BYTES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel_every: int = 7, labels: int = 10,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are rows whose id is divisible by ``every``. A negative's score s serves a positive's p when
    ``window[0] * p <= 100 * s <= window[1] * p``. Where the id is divisible by ``relabel_every`` the label first
    becomes (label + 1) % ``labels``.
    """
    spark = rows.sparkSession
    valid = pick(rows, _id=id_col, _vector=vector_col, _label=label_col).select(
        F.col("_id").cast("long").alias("vec_id"), F.col("_label").cast("long").alias("label"), F.col("_vector").cast("array<double>").alias("vector")
    ).where(F.col("label").isNotNull() & finite("vector"))
    other = F.coalesce(F.col("vec_id") % relabel_every == 0, F.lit(False))
    # Spark rounds down to a long; a double from 2**45 on is whole once scaled, and may not fit one.
    whole = F.transform("vector", lambda x: F.when(F.abs(x) < float(1 << 45), F.floor(scale * x).cast("double")).otherwise(scale * x))
    ready = valid.select(
        "vec_id", F.when(other, (F.col("label") + 1) % labels).otherwise(F.col("label")).alias("label"), whole.alias("vector"),
        F.size("vector").alias("dim"),
    )
    path = work_path(spark, "boxes_rows")
    ready.write.parquet(path)
    ready = spark.read.parquet(path)
    is_anchor = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = ready.select("dim", norm.alias("norm"), is_anchor.alias("anchor")).groupBy("dim").agg(
        F.max("norm").alias("norm"), F.count_if("anchor").alias("anchors")
    ).where("anchors > 0").collect()

    path = work_path(spark, "boxes_anchors")
    anchors = ready.where(is_anchor).distinct().withColumn("deal", F.pmod(F.xxhash64("vector", "vec_id", "label"), F.lit(1 << 30)))
    anchors.write.parquet(path)
    anchors = spark.read.parquet(path)

    out = None
    for fact in facts:
        own_rows, blocks = ready.where(F.col("dim") == fact["dim"]).select("vec_id", "label", "vector"), block_count(fact["anchors"], fact["dim"], block_bytes)
        exact = fact["norm"] < float(1 << 52)
        for block in range(blocks):
            part = anchors.where((F.col("dim") == fact["dim"]) & (F.col("deal") % blocks == block)).toArrow()
            if not part.num_rows:
                continue
            asked, (own, _) = matrix(part.column("vector"), fact["dim"]), ids_of(part.column("vec_id").combine_chunks())
            own_labels = part.column("label").to_numpy()

            def positives_of(_):
                return [Needed(per_anchor)]

            found = own_rows.mapInArrow(
                _searcher(asked, own, own_labels, positives_of, True, exact), "anchor long, vec_id long, score long"
            )
            path = work_path(spark, "boxes_positives")
            _first(found, ["anchor"], per_anchor).write.parquet(path)
            positives = spark.read.parquet(path)

            # At most ``per_anchor`` scores an anchor of the block.
            scores = positives.select("anchor", "score").toArrow()
            windows: dict[int, set[int]] = {}
            for anchor, score in zip(scores.column("anchor").to_pylist(), scores.column("score").to_pylist()):
                windows.setdefault(anchor, set()).add(score)

            def negatives_of(k, windows=windows):
                ends = [(-(-window[0] * p // 100), window[1] * p // 100) for p in windows.get(k, ())]
                return [Needed(per_positive, a, b) for a, b in ends if a <= b]

            found = own_rows.mapInArrow(
                _searcher(asked, own, own_labels, negatives_of, False, exact), "anchor long, vec_id long, score long"
            )
            pairs = positives.select(
                "anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")
            ).join(found, "anchor")
            # A score may take all 64 bits, so its multiples are decimals.
            p, s = F.col("positive_score").cast("decimal(20,0)"), F.col("score").cast("decimal(20,0)")
            fits = (p * window[0] <= s * 100) & (s * 100 <= p * window[1])
            chosen = _first(pairs.where(fits), ["anchor", "place"], per_positive)
            names = spark.createDataFrame(pa.table({"anchor": pa.array(range(len(own)), pa.int64()), "anchor_id": pa.array(own)}))
            chosen = chosen.join(names, "anchor").select(
                "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"),
            )
            out = chosen if out is None else out.unionByName(chosen)
    if out is None:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    return out
