"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slidewatch.llm.sql import SQL  # noqa: F401
from slidewatch.session import work_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from slidewatch.llm import mixing

    return mixing.taken(mixing.mix(_table(spark, folder, "documents")))


def op2_token_records(spark: SparkSession, folder: str) -> DataFrame:
    from slidewatch.llm import records

    path = work_path(spark, "token_records")
    records.write_records(_table(spark, folder, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return records.read_records(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from slidewatch.llm import token_counts

    docs = _table(spark, folder, "documents")
    counts = token_counts.prefix_counts(docs, vocabulary("byte_bpe_50k.json"), limit=1024, keep_prefixes=False)
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from slidewatch.llm import super_kmers

    return super_kmers.dedup(_table(spark, folder, "documents")).drop("kept")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from slidewatch.llm import quality_rules

    return quality_rules.judge(_table(spark, folder, "documents"))


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    from slidewatch.llm import blocks

    pages = _table(spark, folder, "pages")
    return blocks.extract(pages, blocks.train(pages))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from slidewatch.llm import fm_index

    found = fm_index.hits(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from slidewatch.llm import simhash

    found = simhash.components(_table(spark, folder, "documents"), size=3, radius=2)
    return found.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from slidewatch.llm import licenses

    return licenses.scan(_table(spark, folder, "documents")).drop("spans")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from slidewatch.llm import nbsvm

    docs = _table(spark, folder, "documents")
    return nbsvm.score(docs, nbsvm.train(docs, _table(spark, folder, "labels")))


def op11_nearest(spark: SparkSession, folder: str) -> DataFrame:
    from slidewatch.llm import collision_search

    return collision_search.nearest(_table(spark, folder, "embeddings"))


def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    from slidewatch.llm import resampling

    return resampling.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from slidewatch.llm import box_search

    return box_search.hard_negatives(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mixing, op2_token_records, op3_substring_dedup, op4_quality_rules, op5_main_text, op6_decontamination, op7_token_counts, op8_simhash, op9_license_scan,
        op10_quality_classifier, op11_nearest, op12_resampling, op13_hard_negatives,
    )
}
