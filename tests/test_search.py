import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidewatch.functions import text
from slidewatch.operators import search

DOCS = [
    ("e1", "The checkout flow for companies: checkout won, checkouts rose"),
    ("e2", "Android pricing policy; nothing about the flow"),
    ("e3", "Company policies on checkout"),
    ("e4", ""),
    ("e5", "The checkout flow for companies: checkout won, checkouts rose"),
    ("e6", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "experiment_id string, description string")


def brute_force(query):
    bags = {i: text.analyse_words(t) for i, t in DOCS if t is not None}
    n, average = len(DOCS), sum(map(len, bags.values())) / len(bags)
    out = {}
    for i, bag in bags.items():
        score = 0.0
        for term in set(text.analyse_words(query)):
            df = sum(term in b for b in bags.values())
            tf = bag.count(term)
            if tf:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / average))
        if score:
            out[i] = round(score, 8)
    return out


@pytest.mark.parametrize("query", ["checkout companies", "POLICIES of the flow", "company", "nothing here", "the of", "absent"])
def test_bm25_equals_brute_force(docs, query):
    got = {r["experiment_id"]: r["relevance"] for r in search.bm25_search(docs, query, 20).collect()}
    assert got == pytest.approx(brute_force(query))


def test_ties_go_to_the_smaller_id_and_limits_hold(docs):
    rows = [r["experiment_id"] for r in search.bm25_search(docs, "checkout won", 1).collect()]
    assert rows == ["e1"]
    with pytest.raises(ValueError):
        search.bm25_search(docs, "checkout", 0)


def test_column_and_driver_analysers_agree(spark):
    samples = ["Éléments naïfs & THE cafés 42x", "gas bus glass ies dies parties is as", "a-b_c d'e", "", "ſtraße ΑΒΓς"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r["w"] for r in df.select(text.analyse(F.col("t")).alias("w")).collect()]
    assert got == [text.analyse_words(s) for s in samples]


def test_words_of_one_stem_find_each_other(spark):
    groups = {
        "lift": ["lifted", "lifting", "lifts", "lift"], "polici": ["policy", "policies"], "agree": ["agreed", "agrees"], "hop": ["hopping", "hopped"],
        "hope": ["hoping", "hoped", "hope", "hopes"], "relate": ["relating", "related"], "tie": ["ties", "tie"], "feed": ["feed", "feeds"],
        "bus": ["bus"], "gas": ["gas"], "glass": ["glasses", "glass"], "sing": ["sing"], "thing": ["things", "thing"],
    }
    for stem, forms in groups.items():
        assert {text.stem(f) for f in forms} == {stem}
        assert all(f.startswith(text.stem_prefix(stem)) for f in forms)
    docs = spark.createDataFrame([("a", "It lifted conversion"), ("b", "nothing")], "experiment_id string, description string")
    assert [r["experiment_id"] for r in search.bm25_search(docs, "lift", 5).collect()] == ["a"]
    flat = [w for forms in groups.values() for w in forms]
    got = spark.createDataFrame([(flat,)], "w array<string>").select(text.stems(F.col("w")).alias("s")).first()["s"]
    assert got == [text.stem(w) for w in flat]



def test_rank_fusion_of_the_captured_case(spark):
    vector = spark.createDataFrame([("EXP-0000009", 4), ("EXP-0000045", 1), ("EXP-0000020", 3), ("EXP-0000060", 2)], "e string, rank bigint")
    words = spark.createDataFrame([("EXP-0000009", 1), ("EXP-0000045", 4), ("EXP-0000020", 2), ("EXP-0000060", 3)], "e string, rank bigint")
    rows = search.rrf(vector, words, "e").collect()
    assert [(r["e"], r["fused_relevance"]) for r in rows] == [
        ("EXP-0000009", pytest.approx(0.03201844262295082, abs=1e-15)), ("EXP-0000045", pytest.approx(0.03201844262295082, abs=1e-15)),
        ("EXP-0000020", pytest.approx(0.03200204813108039, abs=1e-15)), ("EXP-0000060", pytest.approx(0.03200204813108039, abs=1e-15)),
    ]
    swapped = search.rrf(words, vector, "e").collect()
    assert [(r["e"], r["fused_relevance"]) for r in swapped] == [(r["e"], r["fused_relevance"]) for r in rows]


def test_rank_fusion_keeps_one_sided_rows(spark):
    vector = spark.createDataFrame([("a", 1)], "e string, rank bigint")
    words = spark.createDataFrame([("b", 2)], "e string, rank bigint")
    rows = {r["e"]: (r["vector_rank"], r["bm25_rank"], r["fused_relevance"]) for r in search.rrf(vector, words, "e").collect()}
    assert rows == {"a": (1, None, pytest.approx(1 / 61)), "b": (None, 2, pytest.approx(1 / 62))}


def test_vector_search_equals_numpy(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(200, 16)).astype("float32")
    query = rng.normal(size=16)
    df = spark.createDataFrame([(f"v{i:03d}", v.tolist()) for i, v in enumerate(data)], "experiment_id string, description_embedding array<float>")
    cosine = data.astype("float64") @ query / (np.linalg.norm(data.astype("float64"), axis=1) * np.linalg.norm(query))
    want = [f"v{i:03d}" for i in np.argsort(1 - cosine)[:10]]
    assert [r["experiment_id"] for r in search.vector_search(df, query.tolist(), 10).collect()] == want


def test_wrong_dimension_fails(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "experiment_id string, v array<float>")
    assert search.dim_report(df, "v", 2).first().asDict() == {"vectors": 2, "right_size": 1}
    with pytest.raises(Exception, match="expected 2 dimensions, got 1"):
        search.check_dim(df, "v", 2).collect()


def test_grounding_equals_one_search_per_segment(spark, tables):
    docs = tables.experiments
    some = tables.open_rows.orderBy("segment_id").limit(3)
    for row in search.ground_segments(some, docs).collect():
        best = search.bm25_search(docs, f"{row['cohort']} {row['platform']} {row['region']}", 1).first()
        assert (row["experiment_id"], row["relevance"]) == (best["experiment_id"], pytest.approx(best["relevance"], abs=1e-7))


@pytest.mark.parametrize("seed", [1, 2])
def test_best_documents_are_exact_though_few_are_scored(spark, seed):
    """Random texts with rare and common words, ties, unknown words and texts without any, against scores of all pairs."""
    rng = random.Random(seed)
    common, rare = ["alpha", "beta", "gamma"], [f"region{k}" for k in range(40)]
    docs = [(f"d{k:03d}", " ".join(rng.choices(common, k=rng.randrange(0, 4)) + rng.choices(rare, k=rng.randrange(0, 2)) + ["pad"] * rng.randrange(9))) for k in range(400)]
    docs += [("e1", docs[7][1]), ("e0", docs[7][1]), ("n1", None), ("n2", "")]
    asked = {(c, r): [c, r, "pad"] if k % 3 else [c, r] for k, (c, r) in enumerate((c, r) for c in common for r in [*rare, "unseen"])}
    queries = spark.createDataFrame([(a, b, t) for (a, b), t in asked.items()], "a string, b string, terms array<string>")
    frame = spark.createDataFrame(docs, "id string, text string").repartition(3)
    best, rounds = search.best_documents(queries, ["a", "b"], frame, "id", "text")
    words = {i: (t or "").split() for i, t in docs}
    average = sum(map(len, words.values())) / sum(t is not None for _, t in docs)  # a null text has no length
    score = {}
    for term in {t for own in asked.values() for t in own}:
        df = sum(term in own for own in words.values())
        idf = math.log1p((len(words) - df + 0.5) / (df + 0.5))
        for i, own in words.items():
            tf = own.count(term)
            score[term, i] = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / average)) if tf else 0.0
    want = {}
    for q, terms in asked.items():
        r, i = min((-round(sum(score[t, i] for t in terms), 8), i) for i in words)
        if r < 0:
            want[q] = (i, -r)
    got = {(x["a"], x["b"]): (x["id"], pytest.approx(x["relevance"], abs=1e-7)) for x in best.collect()}
    assert got == want
    pairs = [tuple(x) for r in rounds for x in r.collect()]
    assert len(pairs) == len(set(pairs))


def test_grounding_scores_few_pairs(spark, tables):
    from slidewatch.functions.text import analyse

    terms = F.array_distinct(analyse(F.concat_ws(" ", *search.QUERY)))
    queries = tables.segments.select(*search.QUERY).distinct().select(*search.QUERY, terms.alias("terms"))
    _, rounds = search.best_documents(queries, search.QUERY, tables.experiments, "experiment_id", "description")
    assert sum(r.count() for r in rounds) < 0.1 * queries.count() * tables.experiments.count()
