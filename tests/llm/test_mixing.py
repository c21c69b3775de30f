import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from slidewatch.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict, weights=mixing.WEIGHTS, most=3.0) -> dict:
    """Shares by weight; what is above a cap is shared again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, capped, rest = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        left = rest - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / total for s in names}
        over = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return target
        capped.update(over)


def test_targets_are_shared_until_none_is_above(spark):
    r = random.Random(3)
    for _ in range(4):
        sizes = {name: r.choice([0, 1, 5, 40, 1000]) for name in ["a", "B", "é", "z", None, "", "m"]}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {x["source"]: x["target"] for x in mixing.targets(rows).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_every_document_comes_back_and_sources_meet_their_targets(docs, rows):
    out = mixing.taken(mixing.mix(docs, block_words=16)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((x["doc_id"], x["size"]) for x in out) == Counter((x[0], size(x[1])) for x in rows)
    assert all(x["taken"] <= 3 * x["size"] for x in out)
    sizes = defaultdict(int)
    for x in rows:
        sizes[x[3]] += size(x[1])
    want = brute_targets(sizes)
    by_target = defaultdict(int)
    for x in out:
        by_target[x["source_size"], round(x["target"], 3)] += x["taken"]
    assert by_target == {(sizes[s], round(t, 3)): round(t) for s, t in want.items()}


def test_words_per_shard_come_from_the_tree(docs):
    """Shards hold what the tree gave them; another depth moves words between shards and changes no total."""
    deep, flat = (mixing.taken(mixing.mix(docs, block_words=16, depth=d), d).collect() for d in (3, 1))
    assert all(len(x["shard_words"]) == 8 and sum(x["shard_words"]) == x["taken"] for x in deep)
    assert all(len(x["shard_words"]) == 2 and sum(x["shard_words"]) == x["taken"] for x in flat)
    assert sum(x["taken"] for x in deep) == sum(x["taken"] for x in flat)
    totals = [sum(x["shard_words"][k] for x in deep) for k in range(8)]
    mixed = mixing.mix(docs, block_words=16, depth=3).where("shard is not null").groupBy("shard").sum("n_words").collect()
    assert {k: t for k, t in enumerate(totals) if t} == {x[0]: x[1] for x in mixed if x[1]}


def test_reruns_agree(docs):
    first, second = (sorted(map(tuple, mixing.mix(docs, block_words=16).collect()), key=repr) for _ in range(2))
    assert first == second


def test_shards_are_disjoint_runs_and_quotas_add_up(spark, docs):
    mixed = mixing.mix(docs, block_words=16, depth=3).where("shard is not null")
    rows = mixed.collect()
    assert {x["shard"] for x in rows} == set(range(8))
    draws = Counter((x["doc_id"], x["text_hash"], x["copy"], x["source"], x["block"], x["pass_no"]) for x in rows)
    assert max(draws.values()) == 1
    sizes = Counter(x["shard"] for x in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 3
    quotas = {"+a": 1000, "+b": 37, "+c": 1, "-": 500}
    leaves = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "owner string, quota long"), 4).collect()
    total = Counter()
    for x in leaves:
        total[x["owner"]] += x["quota"]
    assert total == Counter(quotas) and len(leaves) == 64


def test_the_draw_follows_the_hypergeometric_distribution(spark):
    n = 4000
    frame = spark.range(n).select(
        mixing.hypergeometric(
            F.lit(30).cast("long"), F.lit(70).cast("long"), F.lit(40).cast("long"), (F.col("id") + 0.5) / n
        ).alias("x")
    )
    counts = Counter(r["x"] for r in frame.collect())
    from math import comb

    for x in range(31):
        p = comb(30, x) * comb(70, 40 - x) / comb(100, 40)
        assert abs(counts[x] / n - p) < 2 / n
    big = spark.range(1).select(
        mixing.hypergeometric(F.lit(10**8).cast("long"), F.lit(3 * 10**8).cast("long"), F.lit(10**8).cast("long"), F.lit(0.5)).alias("x")
    ).first()["x"]
    assert abs(big - 25_000_000) < 3


def test_whole_documents_are_drawn_for_the_pipeline(docs, no_docs):
    drawn = mixing.mixed_documents(docs)
    assert drawn.columns == docs.columns
    known = {(x["doc_id"], x["text"], x["source"]) for x in docs.collect()}
    assert {(x["doc_id"], x["text"], x["source"]) for x in drawn.collect()} <= known
    counted = mixing.taken(mixing.mix(docs, block_words=None)).agg(F.sum("taken")).first()[0]
    words = sum(len(WORD.findall(x["text"])) for x in drawn.collect())
    assert words == counted
    assert mixing.mixed_documents(no_docs).count() == 0 and mixing.taken(mixing.mix(no_docs)).count() == 0


def test_the_mix_is_built_in_functions_only(docs):
    plan = mixing.taken(mixing.mix(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
