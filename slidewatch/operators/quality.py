"""Data-quality checks. Each returns one row: check_name, passed, observed (a number)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidewatch.functions.exprs import count_if
from slidewatch.operators.joins import attach_scalar
from slidewatch.operators.metrics import dedup_ratio, materialize_metrics, rollup_from, segment_metrics


def _result(row: DataFrame, name: str, passed: Column, observed: Column) -> DataFrame:
    return row.select(
        F.lit(name).alias("check_name"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        F.round(observed.cast("double"), 6).alias("observed"),
    )


class Check(NamedTuple):
    """A check that is an aggregate of one table: its values, and what they say. ``get`` gives a value by name."""

    name: str
    values: Mapping[str, Column]
    passed: Callable[[Callable[[str], Column]], Column]
    observed: Callable[[Callable[[str], Column]], Column]


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All checks of one table by one aggregate, so the table is read once; a row per check."""
    row = df.agg(*[value.alias(f"{c.name}.{v}") for c in checks for v, value in c.values.items()])
    results = []
    for c in checks:
        get = lambda v, name=c.name: F.col(f"`{name}.{v}`")
        results.append(
            F.struct(
                F.lit(c.name).alias("check_name"), F.coalesce(c.passed(get), F.lit(False)).alias("passed"),
                F.round(c.observed(get).cast("double"), 6).alias("observed"),
            )
        )
    return row.select(F.inline(F.array(*results)))


def hero(segment_id: str, cohort: str, platform: str, min_drop: float = 0.01) -> Check:
    own = F.col("segment_id") == segment_id
    good = (
        (F.col("conv_band") == "sliding") & (F.col("conversion_drop") >= min_drop) & (F.col("cohort") == cohort)
        & (F.col("platform") == platform) & (F.col("conversion_at_risk_usd") > 0)
    )
    return Check(
        "hero_sliding", {"n": count_if(own & good), "v": F.max(F.when(own, F.col("conversion_at_risk_usd")))},
        lambda v: v("n") == 1, lambda v: F.coalesce(v("v"), F.lit(0.0)),
    )


def check_hero_match(open_rows: DataFrame, segment_id: str) -> DataFrame:
    good = F.col("has_matching_experiment") & F.col("matching_experiment_id").isNotNull() & (F.col("matching_experiment_lift") > 0)
    row = open_rows.where(F.col("segment_id") == segment_id).agg(
        count_if(good).alias("n"), F.max("matching_experiment_lift").alias("v")
    )
    return _result(row, "hero_has_match", F.col("n") == 1, F.coalesce("v", F.lit(0.0)))


def cluster(platforms: Sequence[str], min_share: float = 0.5) -> Check:
    """Share of the sliding segments that is on the given platforms."""
    sliding = F.col("conv_band") == "sliding"
    share = lambda v: F.when(v("d") > 0, v("n") / v("d")).otherwise(F.lit(0.0))
    values = {"n": count_if(sliding & F.col("platform").isin(list(platforms))), "d": count_if(sliding)}
    return Check("sliding_cluster", values, lambda v: share(v) >= min_share, share)


def confined(clean_platform: str, min_healthy: float = 0.5) -> Check:
    """Most segments are healthy and one platform does not slide. Observed: sliding segments of that platform."""
    values = {
        "n": count_if((F.col("conv_band") == "sliding") & (F.col("platform") == clean_platform)),
        "h": count_if(F.col("conv_band") == "healthy"), "d": F.count(F.lit(1)),
    }
    return Check("anomaly_confined", values, lambda v: (v("n") == 0) & (v("h") >= v("d") * min_healthy), lambda v: v("n"))


def exposure(target_usd: float, healthy: float, sliding: float, tolerance: float = 0.2) -> Check:
    band = F.col("conv_band")
    values = {
        "v": F.sum("conversion_at_risk_usd"), "h": F.avg(F.when(band == "healthy", F.col("conversion_rate"))),
        "s": F.avg(F.when(band == "sliding", F.col("conversion_rate"))),
    }
    near = lambda c, t: F.abs(c - t) <= t * tolerance
    return Check(
        "exposure", values, lambda v: near(v("v"), target_usd) & near(v("h"), healthy) & near(v("s"), sliding), lambda v: v("v")
    )


def signal() -> Check:
    """Mean note signal: sliding at least 0.6, healthy at most 0.2. A missing score counts as 0.1."""
    score = F.coalesce("slide_signal_score", F.lit(0.1))
    values = {
        "s": F.avg(F.when(F.col("conv_band") == "sliding", score)), "h": F.avg(F.when(F.col("conv_band") == "healthy", score)),
    }
    return Check("signal_separates", values, lambda v: (v("s") >= 0.6) & (v("h") <= 0.2), lambda v: v("s") - v("h"))


def check_signal(positions: DataFrame) -> DataFrame:
    return run_checks(positions, [signal()])


def check_note_dedup(snapshots: DataFrame, max_share: float = 0.1) -> DataFrame:
    row = dedup_ratio(snapshots, "pm_note_text")
    return _result(
        row, "note_dedup", F.col("distinct_values") <= F.col("all_rows") * max_share, F.col("distinct_values")
    )


def check_learnable(outcomes: DataFrame) -> DataFrame:
    """A proven variant with a match has the best lift per cost of the actions that cost the same."""
    proven = (F.col("action_type") == "ship_proven_variant") & F.col("had_matching_experiment")
    other = (F.col("ship_cost_usd") == 5000.0) & ~proven
    per_cost = lambda cond: F.sum(F.when(cond, F.col("conversion_lift"))) / F.sum(F.when(cond, F.col("ship_cost_usd")))
    row = outcomes.agg(per_cost(proven).alias("p"), per_cost(other).alias("o"))
    return _result(row, "outcomes_learnable", F.col("p") > F.col("o"), F.col("p") / F.col("o"))


def check_ramp(conv: DataFrame, positions: DataFrame, onset: str) -> DataFrame:
    """Mean rate of the sliding segments before the onset minus the mean after it."""
    sliding = positions.where(F.col("conv_band") == "sliding").select("segment_id")
    before = F.col("snapshot_date") < F.lit(onset).cast("date")
    row = conv.join(sliding, "segment_id", "left_semi").agg(
        F.avg(F.when(before, F.col("conversion_rate"))).alias("b"),
        F.avg(F.when(~before, F.col("conversion_rate"))).alias("a"),
    )
    return _result(row, "slide_ramp", F.col("b") > F.col("a"), F.col("b") - F.col("a"))


def check_action_mix(recs: DataFrame) -> DataFrame:
    row = recs.groupBy("recommended_action").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return _result(row, "action_mix", F.col("n") > 1, F.col("n"))


def domains() -> Check:
    """Observed: rows that break a domain or range rule."""
    good = (
        F.col("platform").isin("ios", "android", "web") & F.col("conv_band").isin("sliding", "watch", "healthy")
        & F.col("conversion_rate").between(0, 1) & (F.col("mau") >= 0)
    )
    values = {"bad": count_if(~F.coalesce(good, F.lit(False))), "n": F.count(F.lit(1))}
    return Check("domains", values, lambda v: (v("bad") == 0) & (v("n") > 0), lambda v: v("bad"))


def check_domains(positions: DataFrame) -> DataFrame:
    return run_checks(positions, [domains()])


def check_row_counts(name: str, one: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables that should have a row for the same things have as many. Observed: the difference."""
    left = one.agg(F.count(F.lit(1)).alias("a"))
    row = attach_scalar(left, other.agg(F.count(F.lit(1)).alias("b")))
    return _result(row, name, F.col("a") == F.col("b"), F.col("a") - F.col("b"))


def check_reconcile(positions: DataFrame) -> DataFrame:
    """The stored metric aggregate gives the same value at risk as the rows. Observed: the difference."""
    stored = rollup_from(materialize_metrics(positions)).select(F.col("conversion_at_risk").alias("a"), F.col("segment_count").alias("an"))
    direct = segment_metrics(positions).select(F.col("conversion_at_risk").alias("b"), F.col("segment_count").alias("bn"))
    row = attach_scalar(stored, direct)
    gap = F.abs(F.col("a") - F.col("b"))
    return _result(row, "metrics_reconcile", (gap < 0.01) & (F.col("an") == F.col("bn")), F.round(gap, 2))


def check_keys(df: DataFrame, key: str) -> DataFrame:
    """Observed: null keys plus surplus rows of repeated keys."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    surplus = F.when(F.col(key).isNull(), F.col("c")).otherwise(F.col("c") - 1)
    row = per_key.agg(F.coalesce(F.sum(surplus), F.lit(0)).alias("bad"))
    return _result(row, f"unique_{key}", F.col("bad") == 0, F.col("bad"))


def check_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Observed: child rows whose non-null key is missing from the parent."""
    missing = child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
    row = missing.agg(F.count(F.lit(1)).alias("bad"))
    return _result(row, f"orphans_{key}", F.col("bad") == 0, F.col("bad"))


def all_checks(results: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for df in results.values():
        out = df if out is None else out.unionByName(df)
    return out
