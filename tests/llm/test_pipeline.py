"""The stages of the pipeline in a row, each held against brute force on its own input."""

import re
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from slidewatch.llm import common, mixing, quality_rules, records
from slidewatch.llm.queries import vocabulary
from slidewatch.session import work_path
from tests.llm.test_copies import LETTERS, brute_components, brute_fingerprint, brute_hits, lower
from tests.llm.test_texts import brute_counts


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs.write.parquet(f"{path}/documents.parquet")
    passage = LETTERS.findall(lower(next(t for i, t, *_ in rows if i == 3000)))
    items = [("i1", " ".join(passage[35:50])), ("i2", None), ("i3", "unseen words of a benchmark item that no document holds at all")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain(frame):
    return [(x["doc_id"], x["text"]) for x in frame.collect()]


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, outputs = docs.columns, {"documents": plain(docs)}
    for name, stage in corpus_pipeline.STAGES:
        path = work_path(spark, f"test_stage_{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "token_records":
            assert docs.columns == columns
            outputs[name] = plain(docs)

    kept = [
        (i, t) for i, t in outputs["documents"]
        if not brute_counts(t)[-1] and not any(rule(quality_rules.Reading(t)) for rule in quality_rules.RULES)
    ]
    assert Counter(outputs["quality_rules"]) == Counter(kept)

    groups = brute_components([brute_fingerprint(t) for _, t in kept], list(range(len(kept))))
    want = {}
    for (i, _), group in zip(kept, groups):
        want[group] = min(want.get(group, (True, 0)), (i is None, i or 0))
    one = outputs["near_dedup"]
    assert sorted((i is None, i or 0) for i, _ in one) == sorted(want.values()) and not Counter(one) - Counter(kept)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = brute_hits(one, items)
    clean = [row for row, hit in zip(one, hits) if not hit[-1]]
    assert Counter(outputs["decontamination"]) == Counter(clean) and len(clean) < len(one)

    mix = Counter(outputs["mixing"])
    assert set(mix) <= set(clean) and all(n <= 3 for n in mix.values())
    sizes = Counter()
    sources = {(x["doc_id"], x["text"]): x["source"] for x in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row, n in mix.items():
        sizes[sources[row]] += n * len(mixing_words(row[1]))
    total = sum(len(mixing_words(t)) for _, t in clean)
    longest = max(len(mixing_words(t)) for _, t in clean)
    assert abs(sum(sizes.values()) - total) <= 6 * longest

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    encoded = Counter()
    for (i, t), n in mix.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        encoded[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += n
    found = docs.collect()
    assert Counter((x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in found) == encoded
    # Records stand as mixing shuffled them, not by id.
    order = [x["doc_id"] for x in sorted(found, key=lambda x: x["start"])]
    assert order != sorted(order, key=lambda i: (i is not None, i or 0))


def mixing_words(text):
    return re.findall(mixing.WORD, text or "")


def test_run_of_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "ids_crc32" in out.columns


class _Held:
    """Stands for a frame and holds the function that a worker would run."""

    columns, schema = ["text"], None

    def mapInArrow(self, function, schema):  # noqa: N802
        self.function = function
        return self


def test_a_worker_gives_up_the_encoder_of_a_run_before():
    encoder = weakref.ref(records._encoder(vocabulary("word_bpe_49k.json"), 2, 100))
    assert encoder() is records._encoder(vocabulary("word_bpe_49k.json"), 2, 100)
    batch = pa.RecordBatch.from_pydict({"text": ["a text of too few words", None]})
    (left,) = quality_rules.keep_good(_Held()).function(iter([batch]))
    assert left.num_rows == 0 and encoder() is None
    first = common.kept("first", set)
    assert common.kept("first", set) is first and common.kept("second", set) is not first and common.kept("first", set) is not first
    common.let_go()


def test_long_texts_come_in_small_batches(spark, folder):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        sizes = spark.range(0, 8000, 1, 1).selectExpr("repeat('x', 2000) AS text").mapInArrow(
            lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long"
        )
        found = [r["n"] for r in sizes.collect()]
        assert len(found) > 1 and max(found) < 2 * common.BATCH_BYTES
        spark.conf.set(setting, "1000")
        common.small_batches(spark)
        assert spark.conf.get(setting) == "1000"
    finally:
        spark.conf.set(setting, before)
