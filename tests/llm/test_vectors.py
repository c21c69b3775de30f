"""Nearest neighbours by collision counting and hard negatives by R-trees, against brute force."""

import math

import numpy as np
import pytest

from slidewatch.llm import box_search, collision_search
from tests.llm.conftest import order

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double, vector string"
NAN, INF = float("nan"), float("inf")


def vectors(seed=3, n=900, dim=12):
    """Unit and other vectors, a third near one another, exact copies, ties, and all that takes no part."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    x[: n // 3] = x[0] + 0.05 * x[: n // 3]
    x[n // 3 : n // 2] /= np.linalg.norm(x[n // 3 : n // 2], axis=1)[:, None]
    x[-40:-20] = x[5]
    x[-20:] = np.round(x[-20:])
    rows = [(k, [float(v) for v in x[k]], int(r.integers(0, 10))) for k in range(n)]
    rows += [
        (2000, None, 1), (2020, [], 1), (2040, [0.0] * dim, 1), (2060, [1.0] * (dim - 1) + [None], 1), (2100, [NAN] + [1.0] * (dim - 1), 1),
        (2120, [INF] + [1.0] * (dim - 1), 1), (None, rows[5][1], 2), (None, None, None), (2200, rows[7][1], None), (2300, [1.0, 2.0], 3),
        (2301, [2.0, 1.0], 3), (2302, [1.0, 1.9], 4), (2400, [0.5], 5), rows[10], rows[10], rows[100], (100, rows[101][1], rows[101][2]),
        (2500, rows[8][1], 11), (-100, rows[9][1], -3), (-7, rows[9][1], -3),
    ]
    return [(*row, k, 0.5, "clash") for k, row in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return vectors()


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors") / "embeddings")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def good(vector):
    return vector is not None and all(v is not None and math.isfinite(v) for v in vector)


def key(score, doc):
    return (-score, doc is None, doc or 0)


def brute_nearest(rows, every, k):
    live = [(i, np.float32(v).astype(np.float64)) for i, v, *_ in rows if good(v) and any(v)]
    asked = {(i, v.tobytes()): v for i, v in live if i is not None and i % every == 0}
    return [
        (i, sorted(((float(np.dot(q, v)), j) for j, v in live if j != i and len(v) == len(q)), key=lambda x: key(*x))[:k])
        for (i, _), q in asked.items()
    ]


def test_nearest_against_brute_force(table, rows):
    got = collision_search.nearest(table, every=20, k=20, level_rows=50).collect()
    want = brute_nearest(rows, 20, 20)
    assert len(got) == sum(len(found) for _, found in want)
    count = sum(1 for i, _ in want if i == 100)
    assert count == 2
    by_query = {}
    for x in got:
        by_query.setdefault(x["query_id"], []).append(x)
    hits = total = 0
    for query, found in want:
        own = sorted(by_query.get(query, []), key=lambda x: x["rank"])
        total += len(found)
        if query == 100:
            hits += len(found)  # two vectors under one id: their answers stand side by side
            continue
        assert [x["rank"] for x in own] == list(range(1, len(found) + 1))
        assert [key(x["score"], x["vec_id"]) for x in own] == sorted(key(x["score"], x["vec_id"]) for x in own)
        left = [(round(s, 9), j) for s, j in found]
        for x in own:
            if (round(x["score"], 9), x["vec_id"]) in left:
                left.remove((round(x["score"], 9), x["vec_id"]))
        hits += len(found) - len(left)
    assert hits / total >= 0.97
    assert not {2000, 2020, 2040, 2060, 2100, 2120} & {x["query_id"] for x in got}


def test_levels_and_blocks_change_nothing_but_the_work(table):
    plain = collision_search.nearest(table, every=60, k=5, level_rows=10**6, chance=1 - 1e-9)
    dealt = collision_search.nearest(table, every=60, k=5, level_rows=20, block_bytes=300, chance=1 - 1e-9)
    assert order(map(tuple, plain.collect())) == order(map(tuple, dealt.collect()))


def test_few_rows_and_empty_tables(spark, table):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [-3.0, 1.0])], schema)
    got = collision_search.nearest(few).orderBy("query_id", "rank").collect()
    assert [tuple(x) for x in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, -3.0), (20, 1, 0, -3.0), (20, 2, 1, -3.0), (20, 3, 2, -3.0)]
    for empty in (table.limit(0), few.where("vec_id = 1")):
        assert collision_search.nearest(empty).count() == 0
        assert box_search.hard_negatives(empty.selectExpr("vec_id", "embedding", "1 AS label")).count() == 0


def test_counters_add_up():
    r = np.random.default_rng(1)
    bits = r.random((37, 3, 128)) < 0.6
    counters = collision_search.Counters((3, 2), 37)
    for k, own in enumerate(bits, 1):
        counters.add(np.packbits(own, axis=1, bitorder="little").view(np.uint64))
        if k in (5, 20, 37):
            for least in (0, 1, k // 2, k):
                got = np.unpackbits(counters.reach(least).view(np.uint8), axis=1, bitorder="little")
                assert (got == (bits[:k].sum(axis=0) >= least)).all()


def test_windows_hold_all_within_reach():
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 8))
    greatest = np.linalg.norm(x, axis=1).max()
    directions = collision_search.lines(8, 16, 1)
    run = collision_search.Run(x, greatest, directions)
    added = np.sqrt(np.maximum(0, 1 - np.sum((x / greatest) ** 2, axis=1)))
    projected = x / greatest @ directions[:-1] + added[:, None] * directions[-1]
    centres, half = r.standard_normal((6, 16)), np.linspace(0, 1.5, 6)
    low, high = run.windows(centres, half)
    for j in range(16):
        bits = np.unpackbits((run.prefix[j][high[j]] ^ run.prefix[j][low[j]]).view(np.uint8), axis=1, bitorder="little")[:, :300]
        inside = np.abs(projected[:, j][None] - centres[:, j][:, None]) <= half[:, None]
        assert (bits >= inside).all()
    assert 0.95 <= sum(math.comb(64, k) * 0.6827**k * 0.3173 ** (64 - k) for k in range(collision_search.threshold(64, 0.95), 65))


def brute_negatives(rows, every=100, per_anchor=5, per_positive=5):
    live = []
    for i, v, label, *_ in rows:
        if label is not None and good(v):
            label = math.fmod(label + 1, 10) if i is not None and i % 7 == 0 else label
            live.append((i, int(label), tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a, label, vector in {x for x in live if x[0] is not None and x[0] % every == 0}:
        scored = [(sum(p * q for p, q in zip(vector, v)), i, other) for i, other, v in live if i != a and len(v) == len(vector)]
        scored.sort(key=lambda x: key(x[0], x[1]))
        for p, i, _ in [x for x in scored if x[2] == label][:per_anchor]:
            fits = [x for x in scored if x[2] != label and 80 * p <= 100 * x[0] <= 100 * p][:per_positive]
            out += [(a, i, rank, j, p, s) for rank, (s, j, _) in enumerate(fits, 1)]
    return out


def test_hard_negatives_against_brute_force(table, rows):
    want = brute_negatives(rows)
    assert len(want) > 60
    got = box_search.hard_negatives(table)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert order(map(tuple, got.collect())) == order(want)
    blocks = box_search.hard_negatives(table, block_bytes=200)
    assert order(map(tuple, blocks.collect())) == order(want)


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**22
    data = [(100, [big, 1.0], 1), (1, [big, 1.0], 1), (2, [big, 0.999], 2), (3, [big, 0.25], 2), (4, [-big, 1.0], 2)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, box_search.hard_negatives(table).collect()))
    square = (256 * 2**22) ** 2
    assert got == [(100, 1, 1, 2, square + 256 * 256, square + 256 * 255), (100, 1, 2, 3, square + 256 * 256, square + 256 * 64)]


def test_pages_are_full_and_boxes_hold_their_rows():
    r = np.random.default_rng(5)
    for n, dim, labels in ((1, 3, 1), (1000, 5, 4), (500, 1, 500), (300, 0, 2), (64, 2, 1)):
        x, own = r.integers(-9, 9, (n, dim)).astype(float), r.integers(0, labels, n)
        tree = box_search.RTree(x, own, page=16, fan=4)
        pages = [p for p in tree.rows if p is not None]
        assert sorted(np.concatenate(pages).tolist()) == list(range(n)) and max(map(len, pages)) <= 16
        assert len(pages) <= 2 * (n / 16) + labels + 1
        q = r.standard_normal((3, dim))
        low, high = tree.intervals(q)
        for k, p in enumerate(tree.rows):
            todo = [k]
            inside = []
            while todo:
                node = todo.pop()
                if tree.rows[node] is None:
                    todo += tree.children[node]
                else:
                    inside += tree.rows[node].tolist()
            scores = q @ x[inside].T
            assert (scores >= low[:, [k]] - 1e-9).all() and (scores <= high[:, [k]] + 1e-9).all()


def test_the_queue_leaves_most_pages_unread():
    """Where vectors have structure, boxes far from the anchor are never opened."""
    r = np.random.default_rng(6)
    x = np.round(256 * np.repeat(r.standard_normal((40, 6)), 100, axis=0) + r.standard_normal((4000, 6)))
    labels, ids = np.zeros(4000, np.int64), np.arange(4000)
    tree = box_search.RTree(x, labels)
    low, high = (v[0].tolist() for v in tree.intervals(x[:1]))
    wanted = [box_search.Needed(5)]
    read = box_search.best_first(tree, low, high, x, labels, x[0], lambda a, b: True, lambda y: y == 0, wanted, ids, np.zeros(4000, bool), 0)
    scores = x @ x[0]
    best = sorted(((-s, i) for i, s in enumerate(scores) if i), key=lambda t: t)[:5]
    assert [(w[0], w[2]) for w in wanted[0].rows] == best
    assert read <= sum(p is not None for p in tree.rows) / 4
