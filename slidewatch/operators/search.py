"""Experiment search: BM25 text ranking, cosine ranking, rank fusion and batch grounding."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidewatch.functions.text import (
    analyse,
    analyse_words,
    stem_prefix,
    stems,
    without_stop_words,
    words,
)
from slidewatch.operators.joins import broadcast_dim
from slidewatch.operators.rank import rank_candidates, top_by
from slidewatch.session import spread, work_path

K1 = 1.2
B = 0.75
CANDIDATES = 50
FUSION_K = 60


def term_weights(docs: DataFrame, id_col: str, text_col: str, term_rows: DataFrame | None = None) -> DataFrame:
    """(id, term, weight): BM25 weight of every term in every document.

    ``term_rows`` (a frame with column ``term``) keeps only those terms: each different word of the corpus is reduced to its
    stem once, and the few that stand for such a term are looked for in the texts. So the corpus itself is never shuffled, only its hits.
    """
    rows = spread(docs.select(id_col, text_col), id_col).select(id_col, words(F.col(text_col)).alias("_words"))
    rows = rows.select(id_col, without_stop_words(F.col("_words")).alias("_words"))
    corpus = rows.agg(F.struct(F.count(F.lit(1)).alias("docs"), F.avg(F.size("_words")).alias("avg_length")))
    if term_rows is None:
        rows = rows.select(id_col, stems(F.col("_words")).alias("_words"), F.size("_words").alias("_length"))
        # explode_outer: from a plain explode Spark infers a filter on the array and would cut the text twice for it.
        hits = rows.select(id_col, "_length", F.explode_outer("_words").alias("term")).where(F.col("term").isNotNull())
    else:
        hits = rows.select(id_col, F.size("_words").alias("_length"), F.explode_outer("_words").alias("word"))
        hits = broadcast_dim(hits, _words_of(rows, term_rows), "word").drop("word")
    counted = hits.groupBy(id_col, "_length", "term").agg(F.count(F.lit(1)).alias("_tf"))
    # Counting over _tf keeps both uses of `counted` the same plan, so that its shuffle is done once.
    frequency = counted.groupBy("term").agg(F.count(F.when(F.col("_tf") > 0, 1)).alias("_df")).withColumn("_corpus", corpus.scalar())
    idf = frequency.select(
        "term", inverse_frequency(F.col("_corpus.docs"), F.col("_df")).alias("_idf"), F.col("_corpus.avg_length").alias("_avg")
    )
    weight = term_weight(F.col("_idf"), F.col("_tf"), F.col("_length"), F.col("_avg"))
    return counted.join(idf, "term").select(id_col, "term", weight.alias("weight"))


def _words_of(rows: DataFrame, term_rows: DataFrame) -> DataFrame:
    """(word, term) for the words of ``rows._words`` whose stem is one of the terms; a written table, so its size is known."""
    found = rows.select(F.explode_outer("_words").alias("word")).where(F.col("word").isNotNull()).distinct()
    found = found.select("word", stems(F.array("word"))[0].alias("term")).join(term_rows.select("term").distinct(), "term", "left_semi")
    path = work_path(rows.sparkSession, "query_words")
    found.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _occurrences(term: str) -> Column:
    return F.size(F.filter("_hits", lambda w: w == term))


def inverse_frequency(n_docs: Column, n_hits: Column) -> Column:
    return F.log1p((n_docs - n_hits + 0.5) / (n_hits + 0.5))


def term_weight(idf: Column, tf: Column, length: Column, avg_length: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))


def bm25_top(docs: DataFrame, query: str, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, relevance) of the ``n`` best documents that share a term with the query; ties by id.

    Each text is read and cut into words once. What is shuffled is one short row per document (length and the
    occurrences of the few query terms); the corpus figures and the scores both start from that shuffle.
    """
    terms = sorted(set(analyse_words(query)))
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("relevance")).limit(0)
    # Few words begin like a query term; only those are reduced to their stems.
    begins = "^(" + "|".join(sorted({re.escape(stem_prefix(t)) for t in terms})) + ")"
    rows = spread(docs.select(id_col, text_col), id_col).select(id_col, words(F.col(text_col)).alias("_words"))
    rows = rows.select(
        id_col, F.size(without_stop_words(F.col("_words"))).alias("_length"),
        stems(F.filter(without_stop_words(F.col("_words")), lambda w: w.rlike(begins))).alias("_hits"),
    )
    rows = rows.select(id_col, "_length", F.array(*[_occurrences(term) for term in terms]).alias("_tf"))
    rows = rows.repartition(id_col)
    hits = [F.count(F.when(F.col("_tf")[i] > 0, 1)) for i in range(len(terms))]
    corpus = rows.agg(
        F.struct(F.count(F.lit(1)).alias("docs"), F.avg("_length").alias("avg_length"), F.array(*hits).alias("hits"))
    )
    scored = rows.withColumn("_corpus", corpus.scalar())
    total = F.lit(0.0)
    for i in range(len(terms)):
        idf = inverse_frequency(F.col("_corpus.docs"), F.col("_corpus.hits")[i])
        total = total + term_weight(idf, F.col("_tf")[i], F.col("_length"), F.col("_corpus.avg_length"))
    hit = F.exists("_tf", lambda times: times > 0)
    # Documents without a hit sort last and are dropped after the limit: a filter before it would be pushed below
    # the shuffle, and the texts would be read twice.
    best = scored.select(id_col, F.round(total, 8).alias("relevance"), hit.alias("_hit"))
    best = best.orderBy(F.col("_hit").desc(), F.col("relevance").desc(), F.col(id_col).asc()).limit(n)
    return best.where("_hit").drop("_hit")


def bm25_search(docs: DataFrame, query: str, n: int = 5, id_col: str = "experiment_id", text_col: str = "description") -> DataFrame:
    """The ``n`` best documents; ``n`` is any positive number."""
    if n < 1:
        raise ValueError("a search returns at least one document")
    return bm25_top(docs, query, n, id_col, text_col)


def check_dim(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """Fails the job on the first vector of another length."""
    wrong = F.raise_error(F.format_string(f"expected {dim} dimensions, got %s", F.size(column).cast("string")))
    return vectors.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(wrong))


def dim_report(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    return vectors.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count(F.when(F.size(column) == dim, 1)).alias("right_size"),
    )


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def vector_distances(vectors: DataFrame, query: Sequence[float] | DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, distance) to a query vector, given as a list or as a one-row frame with column ``query_vector``."""
    if isinstance(query, DataFrame):
        rows = vectors.withColumn("query_vector", query.select("query_vector").scalar())
        other = F.col("query_vector")
    else:
        rows = vectors
        other = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(id_col, F.round(cosine_distance(F.col(vec_col), other), 8).alias("distance"))


def vector_search(vectors: DataFrame, query, n: int = CANDIDATES, id_col: str = "experiment_id", vec_col: str = "description_embedding") -> DataFrame:
    return top_by(vector_distances(vectors, query, id_col, vec_col), "distance", id_col, n, ascending=True)


def rrf(vector_ranks: DataFrame, text_ranks: DataFrame, id_col: str, limit: int = 10, k: int = FUSION_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (columns id and ``rank``); a missing rank adds 0; ties by id."""
    v = vector_ranks.select(id_col, F.col("rank").alias("vector_rank"))
    t = text_ranks.select(id_col, F.col("rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    fused = v.join(t, id_col, "full_outer").withColumn("fused_relevance", part("vector_rank") + part("bm25_rank"))
    return top_by(fused, "fused_relevance", id_col, limit)


def hybrid_search(
    docs: DataFrame, query: str, query_vector, limit: int = 10,
    id_col: str = "experiment_id", text_col: str = "description", vec_col: str = "description_embedding",
    candidates: int = CANDIDATES, vectors: DataFrame | None = None,
) -> DataFrame:
    """Best documents by fused rank of the cosine and the BM25 candidates, with their text.

    ``vectors`` (id and vector) may be a table of its own; texts and vectors are then never joined as a whole, only
    the candidates are, and those are at most ``2 * candidates`` rows.
    """
    near = vector_distances(docs if vectors is None else vectors, query_vector, id_col, vec_col)
    near = rank_candidates(near, "distance", id_col, candidates, ascending=True)
    text = rank_candidates(bm25_top(docs, query, candidates, id_col, text_col), "relevance", id_col, candidates)
    fused = rrf(near, text, id_col, 2 * candidates)
    found = docs.select(id_col, text_col).join(F.broadcast(fused), id_col)
    return top_by(found, "fused_relevance", id_col, max(limit, 1))


QUERY = ["cohort", "platform", "region"]


def ground_segments(open_rows: DataFrame, docs: DataFrame, id_col: str = "experiment_id", text_col: str = "description") -> DataFrame:
    """Best experiment per open segment for the query "cohort platform region".

    Segments share few such texts, so each distinct text is asked once and joined back.
    """
    asked = F.array_distinct(analyse(F.concat_ws(" ", *QUERY)))
    queries = open_rows.select(*QUERY).distinct().select(*QUERY, asked.alias("terms"))
    best, _ = best_documents(queries, QUERY, docs, id_col, text_col)
    found = best.select(*QUERY, id_col, "relevance")
    return open_rows.select("segment_id", *QUERY).join(found, QUERY, "left")


def best_documents(
    queries: DataFrame, key: Sequence[str], docs: DataFrame, id_col: str, text_col: str
) -> tuple[DataFrame, list[DataFrame]]:
    """(key, id, relevance) of the best document of each query (an array of ``terms``), ties by id; exact.

    Documents that cannot be the best are never scored. A term's weight is bounded by its greatest in any document. Terms of a
    query are put in order, fewest documents first, and a document belongs to one class: the first two of these terms that it holds, or
    the one. A class is bounded by its two terms and all later ones. First only documents with the two rarest terms are
    scored; the best of them is a mark. Then only classes whose bound reaches the mark are. Scores are made inside the row of a
    document, from its weights, and are reduced to one row a query before anything is shuffled.

    The second value holds the (key, id) pairs that were scored, per round.
    """
    spark = docs.sparkSession
    key = list(key)
    path = work_path(spark, "query_postings")
    exploded = queries.select(*key, F.explode("terms").alias("term"))
    term_weights(docs, id_col, text_col, term_rows=exploded).write.parquet(path)
    postings = spark.read.parquet(path)
    bounds = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("most"))
    # One row a query: its terms that occur, rarest first, with their bounds.
    listed = exploded.join(bounds, "term").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("n", "term", "most"))).alias("terms"))
    path = work_path(spark, "query_terms")
    listed.write.parquet(path)
    listed = spark.read.parquet(path)
    own = postings.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"))
    path = work_path(spark, "query_documents")
    own.write.parquet(path)
    own = spark.read.parquet(path)

    def scored(classes: DataFrame) -> DataFrame:
        """Pairs of a query and a document of one of its classes."""
        held = own.select(id_col, "weights", F.explode(F.map_keys("weights")).alias("lead"))
        holds = lambda t: F.map_contains_key("weights", t)
        pairs = broadcast_dim(held, classes, "lead").where(
            (F.col("second").isNull() | holds(F.coalesce("second", F.lit("")))) & ~F.exists("without", holds)
        )
        weight = F.aggregate("terms", F.lit(0.0), lambda total, t: total + F.coalesce(F.col("weights")[t["term"]], F.lit(0.0)))
        return pairs.select(*key, id_col, F.round(weight, 8).alias("relevance"))

    def best_of(pairs: DataFrame) -> DataFrame:
        order = F.struct((-F.col("relevance")).alias("r"), F.col(id_col))
        return pairs.groupBy(*key).agg(F.min_by(F.struct(id_col, "relevance"), order).alias("best")).select(*key, "best.*")

    i, j, size = F.col("i"), F.col("j"), F.size("terms")
    names = lambda part: F.transform(part, lambda t: t["term"])
    places = listed.withColumn("i", F.explode(F.sequence(F.lit(1), size)))
    places = places.withColumn("j", F.explode(F.sequence(i + 1, size + 1)))  # one beyond the last: no second term
    later = F.aggregate(F.slice("terms", j, size), F.lit(0.0), lambda total, t: total + t["most"])
    classes = places.select(
        *key, "terms", "i", "j", F.get("terms", i - 1)["term"].alias("lead"), F.get("terms", j - 1)["term"].alias("second"),
        names(F.concat(F.slice("terms", F.lit(1), i - 1), F.slice("terms", i + 1, j - i - 1))).alias("without"),
        (F.get("terms", i - 1)["most"] + later).alias("bound"),
    )
    path = work_path(spark, "query_classes")
    classes.write.parquet(path)
    classes = spark.read.parquet(path)
    rarest = (i == 1) & (j == 2)
    first = scored(classes.where(rarest))
    path = work_path(spark, "query_marks")
    best_of(first).write.parquet(path)
    marks = spark.read.parquet(path)

    rest = classes.where(~rarest).join(marks.select(*key, "relevance"), key, "left")
    rest = rest.where(F.col("bound") >= F.coalesce("relevance", F.lit(0.0)) - 1e-7)
    path = work_path(spark, "query_rest")
    rest.drop("relevance").write.parquet(path)
    second = scored(spark.read.parquet(path))
    best = best_of(marks.unionByName(best_of(second)))
    return best, [first.select(*key, id_col), second.select(*key, id_col)]


def find_experiment(docs: DataFrame, experiment_id: str, id_col: str = "experiment_id") -> DataFrame:
    return docs.where(F.col(id_col) == experiment_id)
