"""Quality classifier: naive Bayes log-count ratios and a linear support vector machine (NB-SVM).

A text's features are indicators of its word n-grams, of one and two words, hashed to ``BINS`` places. A word counts in two
forms: itself, lowered, and its shape (letter case, digits, the marks around it, its length class), so that junk written
in unseen words is seen too. A third kind says how often a form repeats, in powers of two. Each indicator is scaled by the
naive Bayes log-count ratio of its feature, and a hinge-loss model is fitted on the scaled indicators by dual coordinate
descent. A logistic curve over the margins, fitted on the same rows, gives the score.

The model is fitted on at most ``rows`` labelled documents, those with the least hash of their id, which is a documented
bound; every document is scored on its whole text. The held-out rows take no part in any of it.

Defined results: null and empty texts have no features and get the score of an empty text; null doc_ids are scored and not
held out; documents with a null label, or several different ones, are not learned from; repeated rows give repeated
results; with labels of one kind only the score is that kind's share; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidewatch.llm.common import blank_words, map_rows, pick

BINS = 1 << 18
ROWS = 4000
HELD_OUT = 2
FOLDS = 4
THRESHOLD = 0.7

_MIX = np.uint64(0x9E3779B97F4A7C15)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def shape(word: str) -> str:
    """Case, digits and the marks of a word, and whether it is short, usual or long."""
    head = "A" if word.isupper() and len(word) > 1 else "a" if word.islower() else "Aa" if word[:1].isupper() else "x"
    marks = "".join(sorted({c for c in word if not c.isalnum()}))[:8]
    digits = "0" if any(map(str.isdigit, word)) else ""
    size = "s" if len(word) < 4 else "m" if len(word) < 12 else "l" if len(word) < 30 else "xl"
    return f"{head}{digits}{size}{marks}"


class Forms(dict):
    """Hashes of a word's lowered form and shape, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 300_000:
            self.clear()
        text = word.decode("utf-8", "replace")
        value = self[word] = (xxhash.xxh64_intdigest(text.lower(), 1), xxhash.xxh64_intdigest(shape(text), 2))
        return value


def features(text: str | None, forms: Forms, bins: int = BINS) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    words = blank_words(text)
    if not words:
        return np.empty(0, np.int64)
    pairs = np.array([*map(forms.__getitem__, words)], np.uint64)
    kinds = []
    for k in (0, 1):
        form = pairs[:, k]
        # A pair is a chain of two hashes, so its order counts.
        kinds += [form, (form[:-1] * _MIX) ^ (form[1:] >> np.uint64(7)) ^ np.uint64(k + 1)]
    values, counts = np.unique(pairs[:, 0], return_counts=True)
    often = np.log2(counts.max() / len(words) * 64 + 1).astype(np.uint64)
    fill = np.uint64(np.log2(len(values) / len(words) * 64 + 1))
    kinds.append(np.array([often + np.uint64(1 << 40), fill + np.uint64(1 << 41)], np.uint64))
    hashed = np.concatenate(kinds) * _MIX
    return np.unique((hashed >> np.uint64(40)) % np.uint64(bins)).astype(np.int64)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        size = max(1.0, math.sqrt(len(found)))
        return float(self.weights[found].sum()) / size + self.bias

    def score(self, found: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * self.margin(found) + self.offset))))


def fit(rows: list[np.ndarray], labels: np.ndarray, bins: int = BINS, cost: float = 1.0, rounds: int = 30, smooth: float = 1.0) -> Model:
    """NB-SVM on feature lists and 0/1 labels; deterministic."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(bins), 0.0, 0.0, math.log(share / (1 - share)))
    counts = np.full((2, bins), smooth)
    for found, label in zip(rows, labels):
        counts[label, found] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    sizes = np.array([max(1.0, math.sqrt(len(f))) for f in rows])
    y = np.where(labels == 1, 1.0, -1.0)
    # The rarer class weighs as much as the other.
    upper = cost * np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    values = [ratio[f] / s for f, s in zip(rows, sizes)]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    weights, bias, alpha = np.zeros(bins), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(1)
    for _ in range(rounds):
        moved = 0.0
        for k in order.permutation(len(rows)):
            gradient = y[k] * (float(weights[rows[k]] @ values[k]) + bias) - 1.0
            new = min(max(alpha[k] - gradient / norms[k], 0.0), upper[k])
            step = (new - alpha[k]) * y[k]
            if step:
                weights[rows[k]] += step * values[k]
                bias += step
                moved = max(moved, abs(step))
                alpha[k] = new
        if moved < 1e-4:
            break
    margins = np.array([float(weights[f] @ v) + bias for f, v in zip(rows, values)])
    slope, offset = _logistic(margins, labels)
    return Model(weights * ratio, bias, slope, offset)


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's curve by Newton steps, with his smoothed targets."""
    good = int(labels.sum())
    bad = len(labels) - good
    goal = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, w = p - goal, np.maximum(p * (1 - p), 1e-6)
        g = np.array([d @ margins, d.sum()]) + 1e-3 * np.array([a - 1, b])
        h = np.array([[w @ margins**2, w @ margins], [w @ margins, w.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(
    docs: DataFrame, labels: DataFrame, rows: int = ROWS, bins: int = BINS, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Fits on the ``rows`` labelled documents outside the held-out fold whose ids have the least hashes."""
    marks = pick(labels, _id=id_col, _label=label_col).where("_id is not null and _label is not null")
    marks = marks.where(F.pmod(F.crc32(F.col("_id").cast("long").cast("string")), F.lit(FOLDS)) != HELD_OUT)
    marks = marks.groupBy(F.col("_id").cast("long").alias("_id")).agg(
        F.min("_label").cast("int").alias("_label"), F.max("_label").cast("int").alias("_most")
    )
    marks = marks.where("_label = _most").orderBy(F.xxhash64("_id"), "_id").limit(rows).select("_id", "_label")
    texts = pick(docs, _doc=id_col, _text=text_col).select(F.col("_doc").cast("long").alias("_doc"), "_text")

    def listed(batches):
        forms = Forms()
        for ids, labels_, texts_ in batches:
            yield ids, labels_, [features(t, forms, bins).astype("<i4").tobytes() for t in texts_]

    # The sample is bounded by ``rows``, whatever the size of the tables.
    chosen = texts.join(F.broadcast(marks), texts["_doc"] == marks["_id"]).select("_doc", "_label", "_text")
    found = map_rows(chosen, "doc_id long, label int, found binary", listed).dropDuplicates(["doc_id", "found"])
    sample = sorted((r["doc_id"], r["label"], bytes(r["found"])) for r in found.collect())
    return fit(
        [np.frombuffer(f, "<i4").astype(np.int64) for _, _, f in sample], np.array([q for _, q, _ in sample], np.int64), bins
    )


def score(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bins = len(model.weights)

    def scored(batches):
        forms, fitted = Forms(), shared.value
        for ids, texts in batches:
            scores = [fitted.score(features(t, forms, bins)) for t in texts]
            yield ids, [is_held_out(i) for i in ids], scores, [int(s >= threshold) for s in scores]

    rows = pick(docs, _id=id_col, _text=text_col).select(F.col("_id").cast("long").alias("_id"), "_text")
    return map_rows(rows, "doc_id long, held_out boolean, score double, predicted int", scored)
