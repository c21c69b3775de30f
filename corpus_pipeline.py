"""From raw documents to shuffled token files: quality rules, near-dedup, decontamination, mixing, binary output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet in the shared
folder and reads it again as the next one's ``docs``. All but the last return the columns of ``documents``.

1. ``quality_rules``: documents that a rule rejects go.
2. ``near_dedup``: one document of each SimHash component (three-word shingles, at most two bits apart) stays.
3. ``decontamination``: documents that hold a benchmark window go.
4. ``mixing``: documents are drawn so that the words of each source come near its target; a document drawn twice is two
   rows, one not drawn goes. Rows come in shards, shuffled within each.
5. ``token_records``: the mix is written as framed token records, in the order of shards and places that mixing gave; the
   result has one row per record, read back from the files: doc_id, n_tokens, ids_crc32 and its place.

Defined results: null text has no words and goes in stage 1; equal rows are one document after stage 2, texts of equal
fingerprints too; empty tables give empty results in every stage; extra columns pass through to stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slidewatch.llm import fm_index, mixing, quality_rules, records, simhash
from slidewatch.llm.common import small_batches
from slidewatch.llm.queries import vocabulary
from slidewatch.session import work_path

#: Words whose ids a worker keeps in the last stage, twice this at most.
WORDS_KEPT = 120_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.one_of_each(docs, size=3, radius=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return fm_index.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def records_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = work_path(spark, "pipeline_records")
    # A smaller cache of words than in a job of its own: workers live on from stage to stage and share the executor's memory.
    records.write_records(docs, path, vocabulary("word_bpe_49k.json"), end_id=1, by_id=False, words_kept=WORDS_KEPT)
    return records.read_records(spark, path)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_records", records_stage),
]

#: Stages 2, 4 and 5 cannot be written in SQL: XXH64, seeded draws, and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
