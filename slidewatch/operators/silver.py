"""Raw tables to silver tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidewatch.functions.scan import join_by_slice
from slidewatch.operators.joins import BROADCAST_LIMIT_BYTES
from slidewatch.session import size_in_bytes
from slidewatch.settings import LABEL_SCORES, NOTE_LABELS

SEGMENT_DIMS = ["cohort", "platform", "region"]


def label_note(note: Column, labels: Mapping[str, str] = NOTE_LABELS) -> Column:
    """Label of a note by the phrases it contains; a note with no known phrase is ``at_risk``."""
    out = None
    for phrase, label in labels.items():
        hit = F.lower(note).contains(phrase)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit("at_risk"))


def label_score(label: Column) -> Column:
    out = None
    for name, score in LABEL_SCORES.items():
        out = F.when(label == name, F.lit(score)) if out is None else out.when(label == name, F.lit(score))
    return out


def note_slide_flags(snapshots: DataFrame, labels: Mapping[str, str] = NOTE_LABELS) -> DataFrame:
    """One row per distinct note: notes are made distinct first, so each is classified once."""
    notes = snapshots.select("pm_note_text").where(F.col("pm_note_text").isNotNull()).distinct()
    labelled = notes.withColumn("label", label_note(F.col("pm_note_text"), labels))
    return labelled.withColumn("slide_signal_score", label_score(F.col("label")))


def silver_events(events: DataFrame, segments: DataFrame) -> DataFrame:
    """Daily rollup per segment. Sessions are summed before the join, so a hot segment joins as one row a day."""
    daily = events.groupBy("segment_id", "event_date").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum(F.col("converted").cast("int")).cast("long").alias("conversions"),
        F.sum("revenue_usd").alias("revenue"),
    )
    daily = daily.withColumn("conversion_rate", F.col("conversions") / F.col("sessions"))
    dims = segments.select("segment_id", *SEGMENT_DIMS)
    return daily.join(dims, "segment_id")


def silver_conv(snapshots: DataFrame, segments: DataFrame, notes: DataFrame) -> DataFrame:
    """Snapshots with segment dims and note score; a null note keeps a null score.

    Notes that are known to be few (a written table, by its files) go to every task, so no snapshot moves for them. Of a larger table a
    frequent note is spread over the days of its snapshots, and rows without a note take no part in the join.
    """
    dims = segments.select("segment_id", *SEGMENT_DIMS, "segment_summary", "mau")
    scores = notes.select("pm_note_text", "slide_signal_score")
    rows = snapshots.join(dims, "segment_id")
    if size_in_bytes(scores) <= BROADCAST_LIMIT_BYTES:
        return rows.join(F.broadcast(scores), "pm_note_text", "left")
    noted = join_by_slice(
        rows.where(F.col("pm_note_text").isNotNull()), scores, ["pm_note_text"], F.col("snapshot_date"), "left"
    )
    return noted.unionByName(rows.where(F.col("pm_note_text").isNull()), allowMissingColumns=True)


def silver_flags(flags: DataFrame) -> DataFrame:
    """Current flag per (segment, area): the latest ``updated_date``, then the smallest ``flag_id``.

    Rows hold text, so Spark sorts what a task combines. They are dealt into partitions of a measured size first, large ones cut,
    so that a task sorts no more than that however few files the rows come from, also of a hot segment.
    """
    rest = [c for c in flags.columns if c not in ("segment_id", "feature_area")]
    newest_first = F.struct(
        F.datediff(F.lit("9999-12-31").cast("date"), "updated_date").alias("age"), F.col("flag_id")
    )
    dealt = flags.hint("rebalance", "segment_id")
    best = dealt.groupBy("segment_id", "feature_area").agg(F.min_by(F.struct(*rest), newest_first).alias("row"))
    return best.select("segment_id", "feature_area", "row.*")


def silver_outcomes(outcomes: DataFrame, segments: DataFrame) -> DataFrame:
    return outcomes.join(segments.select("segment_id", *SEGMENT_DIMS), "segment_id")


def expect(df: DataFrame, rules: Mapping[str, Column], mode: str = "drop") -> tuple[DataFrame, DataFrame]:
    """Row expectations. Returns the rows and one metrics row per rule: (rule, passed, failed).

    ``drop`` keeps the rows that meet every rule, ``warn`` keeps all rows, ``fail`` raises when a rule is broken.
    A rule that evaluates to null counts as broken.
    """
    met = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    metrics = expectation_metrics(df, met)
    if mode == "fail":
        broken = [(r["rule"], r["failed"]) for r in metrics.where("failed > 0").collect()]  # one row per rule
        if broken:
            raise ValueError(f"expectations not met: {broken}")
        return df, metrics
    if mode == "warn":
        return df, metrics
    if mode != "drop":
        raise ValueError(f"unknown mode: {mode}")
    kept = df
    for rule in met.values():
        kept = kept.where(rule)
    return kept, metrics


def expectation_metrics(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One pass over the data; all rules are counted together and then turned into rows."""
    counts: Sequence[Column] = [
        F.struct(
            F.lit(name).alias("rule"),
            F.count(F.when(rule, 1)).alias("passed"),
            F.count(F.when(~rule, 1)).alias("failed"),
        ).alias(f"r{i}")
        for i, (name, rule) in enumerate(rules.items())
    ]
    one = df.agg(*counts)
    return one.select(F.inline(F.array(*[F.col(f"r{i}") for i in range(len(counts))])))
