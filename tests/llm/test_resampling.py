"""Importance resampling against a brute-force version, and its checksum arithmetic."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidewatch.llm import resampling
from tests.llm.conftest import order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_runs(text):
    words = WORD.findall((text or "").encode().lower().decode())
    return words, [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def brute(rows, target, least=20, percent=5):
    bucket = lambda run: zlib.crc32(run.encode()) % 10000
    source, aim = Counter(), Counter()
    for _, text in rows:
        source.update(map(bucket, brute_runs(text)[1]))
    for text in target:
        aim.update(map(bucket, brute_runs(text)[1]))
    s, t = sum(source.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((source[b] + 1) * (t + 10000))))
    out, able = [], []
    for doc, text in rows:
        words, runs = brute_runs(text)
        weight = sum(gain(bucket(r)) for r in runs)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, len(runs), weight, score))
        able.append(len(words) >= least)
    drawn = sum(able) * percent // 100
    places = sorted((x[3] for x, good in zip(out, able) if good), reverse=True)
    return out, drawn, places


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([("w1 w2 the W3, naïve 漢字 w9",), (None,), ("",), ("the the w5 w6 w7",)], "text string")


def test_every_row_against_brute_force(docs, no_docs, rows, target):
    found = resampling.resample(docs, target)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in found.dtypes} == {"bigint"}
    got = found.collect()
    want, drawn, places = brute([(r[0], r[1]) for r in rows], [r["text"] for r in target.collect()])
    assert order(tuple(x)[:4] for x in got) == order(want)
    ranked = sorted((x for x in got if x["rank"] is not None), key=lambda x: x["rank"])
    assert drawn > 2 and [x["rank"] for x in ranked] == list(range(1, drawn + 1))
    assert [x["score"] for x in ranked] == places[:drawn]
    ties = [((-x["score"]), x["doc_id"] is None, x["doc_id"] or 0) for x in ranked]
    assert ties == sorted(ties)
    assert resampling.resample(no_docs, target).count() == 0
    assert {r["weight"] for r in resampling.resample(docs.where("doc_id = 4001"), target.limit(0)).collect()} == {0}


def test_a_hot_text_and_long_texts_rank_whole(spark, target):
    """A third of the rows are one text, some have one id, two are very long; more ranges than rows of some of them."""
    text = "w1 w2 w3 " * 10
    long = " ".join(f"x{k % 977}" for k in range(120_000))
    data = [(k, text) for k in range(300)] + [(7, text)] * 100 + [(1000 + k, f"{text} own{k}") for k in range(500)] + [(5000, long), (5001, long)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    got = resampling.resample(docs, target).orderBy(F.col("score").desc()).collect()
    drawn = len(data) * 5 // 100
    assert sorted(x["rank"] for x in got if x["rank"] is not None) == list(range(1, drawn + 1))
    assert [x["score"] for x in got[:drawn]] == [x["score"] for x in sorted(got, key=lambda x: x["rank"] or 10**9)[:drawn]]
    assert {x["n_features"] for x in got if x["doc_id"] == 5000} == {3 * 120_000 - 3}
    again = {(x["doc_id"], x["score"], x["rank"]) for x in resampling.resample(docs, target).collect()}
    assert {(x["doc_id"], x["score"], x["rank"]) for x in got if x["doc_id"] != 7} == {x for x in again if x[0] != 7}


@pytest.mark.parametrize(("words", "piece"), [(1, 4), (2, 7), (5, 2048), (100_000, 3)])
def test_windows_over_pieces_and_batches(monkeypatch, words, piece):
    monkeypatch.setattr(resampling, "WORDS", words)
    monkeypatch.setattr(resampling, "PIECE", piece)
    texts = ["Hello wörld foo, bar-baz qux " * 5 + "x" * 1000 + " " + "y" * 300 + " end", "", "one", "a b", "İ q é"]
    windows, got = resampling.Windows(3, 10_000), Counter()
    for owner, text in enumerate(texts):
        for made in windows.add(owner, text):
            got.update(zip(*(x.tolist() for x in made)))
    got.update(zip(*(x.tolist() for x in windows.rest())))
    assert got == Counter((k, zlib.crc32(run.encode()) % 10_000) for k, text in enumerate(texts) for run in brute_runs(text)[1])


def test_checksums_move_over_any_distance():
    moved = resampling.Moved()
    for size in (0, 1, 2, 127, 128, 129, 1000, 70_000):
        tail = bytes(range(256)) * (size // 256 + 1)
        crc = moved(np.array([zlib.crc32(b"head")], np.uint32), np.array([size])) ^ np.uint32(zlib.crc32(tail[:size]))
        assert int(crc[0]) == zlib.crc32(b"head" + tail[:size])


def test_word_counts_follow_from_feature_counts():
    for runs in (1, 2, 3):
        for n in range(12):
            assert resampling._words_of(sum(max(0, n - k) for k in range(runs)), runs) == n
