"""Silver tables to gold tables: position, open sliding set, candidate actions, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidewatch.functions.exprs import at_risk, conv_band, conversion_drop, net_value
from slidewatch.settings import ACTIONS, OPEN_BANDS, REVENUE_PER_CONVERSION, ActionRule, BandRule

RANKING_TYPE = (
    "array<struct<action_type:string,conversion_lift:double,ship_cost_usd:double,net_value_usd:double>>"
)


def segment_position(
    conv: DataFrame,
    events: DataFrame,
    as_of: str,
    window_days: int = 30,
    recent_days: int = 7,
    rule: BandRule = BandRule(),
    per_conversion: float = REVENUE_PER_CONVERSION,
) -> DataFrame:
    """One row per segment: newest snapshot of the window against its oldest, band, value at risk, recent sessions.

    ``conv`` is silver_conv and ``events`` silver_events. Both date ranges are plain filters, so they reach the
    scan of date-partitioned silver tables. Newest and oldest are taken by max_by/min_by, which combine map-side.
    """
    day = F.lit(as_of).cast("date")
    in_window = conv.where(
        (F.col("snapshot_date") <= day) & (F.col("snapshot_date") > F.date_sub(day, window_days))
    )
    dims = ["segment_id", "cohort", "platform", "region", "segment_summary", "mau"]
    by_segment = in_window.groupBy(*dims).agg(
        F.max_by("conversion_rate", "snapshot_date").alias("conversion_rate"),
        F.min_by("conversion_rate", "snapshot_date").alias("conversion_rate_3w_ago"),
        F.max_by("slide_signal_score", "snapshot_date").alias("slide_signal_score"),
    )
    recent = (
        events.where((F.col("event_date") <= day) & (F.col("event_date") > F.date_sub(day, recent_days)))
        .groupBy("segment_id")
        .agg(F.sum("sessions").cast("long").alias("sessions"))
    )
    out = by_segment.join(recent, "segment_id", "left")
    out = out.withColumn("sessions", F.coalesce("sessions", F.lit(0).cast("long")))
    out = out.withColumn("conversion_drop", conversion_drop("conversion_rate_3w_ago", "conversion_rate"))
    out = out.withColumn("conv_band", conv_band("conversion_drop", "conversion_rate", rule))
    return out.withColumn(
        "conversion_at_risk_usd", at_risk("mau", "conversion_drop", "conv_band", per_conversion)
    )


def best_proven(experiments: DataFrame, area: str = "checkout") -> DataFrame:
    """Best won experiment per (cohort, platform): highest lift, then smallest id. One row per pair."""
    won = experiments.where(F.col("won") & (F.col("feature_area") == area))
    pick = F.struct(F.col("experiment_id").alias("matching_experiment_id"), F.col("observed_lift").alias("matching_experiment_lift"))
    best = won.groupBy("tested_cohort", "tested_platform").agg(
        F.min_by(pick, F.struct((-F.col("observed_lift")).alias("lift"), F.col("experiment_id"))).alias("best")
    )
    return best.select(F.col("tested_cohort").alias("cohort"), F.col("tested_platform").alias("platform"), "best.*")


def match_experiment(positions: DataFrame, experiments: DataFrame, area: str = "checkout") -> DataFrame:
    # One short row per cohort and platform: two closed lists, so the lookup does not grow with the segments, and the
    # positions of a frequent pair stay where they are.
    out = positions.join(F.broadcast(best_proven(experiments, area)), ["cohort", "platform"], "left")
    return out.withColumn("has_matching_experiment", F.col("matching_experiment_id").isNotNull())


def neighbor_candidates(flags: DataFrame, segments: DataFrame, area: str = "checkout") -> DataFrame:
    """Best non-control flag per (platform, cohort): highest rollout, then smallest segment id."""
    live = flags.where((F.col("feature_area") == area) & (F.col("variant") != "control"))
    live = live.join(segments.select("segment_id", "cohort", "platform"), "segment_id")
    pick = F.struct("flag_key", "variant", "rollout_pct", "segment_id")
    best = live.groupBy("platform", "cohort").agg(
        F.min_by(pick, F.struct((-F.col("rollout_pct")).alias("pct"), F.col("segment_id"))).alias("best")
    )
    return best.select("platform", "cohort", "best.*")


def neighbor_flag(
    positions: DataFrame, flags: DataFrame, segments: DataFrame, area: str = "checkout"
) -> DataFrame:
    """The best flag of another cohort on the same platform.

    Only the two best cohorts of a platform can ever be the answer (the second serves the first), so the lookup
    has one row per platform and no pairs of segments are formed.
    """
    best = neighbor_candidates(flags, segments, area)
    by_rollout = Window.partitionBy("platform").orderBy(F.col("rollout_pct").desc(), F.col("segment_id").asc())
    order = best.withColumn("n", F.row_number().over(by_rollout)).where("n <= 2")  # one row per cohort
    picked = F.struct("cohort", "flag_key", "variant", "segment_id")
    lookup = order.groupBy("platform").agg(
        F.max(F.when(F.col("n") == 1, picked)).alias("_first"),
        F.max(F.when(F.col("n") == 2, picked)).alias("_second"),
    )
    # One row per platform, a closed list of three.
    out = positions.join(F.broadcast(lookup), "platform", "left")
    chosen = F.when(F.col("_first.cohort") != F.col("cohort"), F.col("_first")).otherwise(F.col("_second"))
    out = out.withColumn("_chosen", chosen)
    return out.withColumns(
        {
            "neighbor_flag_key": F.col("_chosen.flag_key"),
            "neighbor_variant": F.col("_chosen.variant"),
            "neighbor_segment_id": F.col("_chosen.segment_id"),
        }
    ).drop("_first", "_second", "_chosen")


def open_sliding(
    positions: DataFrame, experiments: DataFrame, flags: DataFrame, segments: DataFrame, area: str = "checkout"
) -> DataFrame:
    """Sliding and watch segments with their proven experiment and neighbouring flag."""
    open_rows = positions.where(F.col("conv_band").isin(OPEN_BANDS))
    matched = match_experiment(open_rows, experiments, area)
    return neighbor_flag(matched, flags, segments, area).select(
        "segment_id", "cohort", "platform", "region", "mau", "conversion_rate", "conversion_drop",
        "conversion_at_risk_usd", "conv_band", "has_matching_experiment", "matching_experiment_id",
        "matching_experiment_lift", "neighbor_flag_key",
    )


def candidate_costs(rule: ActionRule = ActionRule()) -> dict[str, float]:
    return {
        "ship_proven_variant": rule.ship_cost,
        "rollout_existing_flag": rule.rollout_cost,
        "ship_alt_variant": rule.ship_cost,
    }


def action_candidates(open_rows: DataFrame, rule: ActionRule = ActionRule()) -> DataFrame:
    """Three rows per open segment. They are made inside the row, so nothing is shuffled."""
    proven = F.when(
        F.col("has_matching_experiment"), F.col("matching_experiment_lift") * F.lit(rule.proven_share)
    ).otherwise(F.lit(rule.proven_floor))
    lifts = {
        "ship_proven_variant": proven,
        "rollout_existing_flag": F.lit(rule.rollout_lift),
        "ship_alt_variant": F.lit(rule.alt_lift),
    }
    costs = candidate_costs(rule)
    options = F.array(
        *[
            F.struct(
                F.lit(action).alias("action_type"),
                lifts[action].cast("double").alias("conversion_lift"),
                F.lit(costs[action]).alias("ship_cost_usd"),
                F.lit(n).alias("action_order"),
            )
            for n, action in enumerate(ACTIONS)
        ]
    )
    return open_rows.select("*", F.inline(options))


def with_net_value(candidates: DataFrame, per_conversion: float = REVENUE_PER_CONVERSION) -> DataFrame:
    return candidates.withColumn(
        "net_value_usd", net_value("conversion_lift", "mau", "ship_cost_usd", per_conversion)
    )


def recommend(candidates: DataFrame, scored_at: str) -> DataFrame:
    """Best action per segment and all its options in order. A group is the three options of one segment."""
    option = F.struct(
        (-F.col("net_value_usd")).alias("_key"), "action_order",
        "action_type", "conversion_lift", "ship_cost_usd", "net_value_usd",
    )
    ranked = candidates.groupBy("segment_id").agg(F.array_sort(F.collect_list(option)).alias("_options"))
    ranking = F.transform(
        "_options",
        lambda o: F.struct(
            o["action_type"].alias("action_type"), o["conversion_lift"].alias("conversion_lift"),
            o["ship_cost_usd"].alias("ship_cost_usd"), o["net_value_usd"].alias("net_value_usd"),
        ),
    )
    ranked = ranked.select("segment_id", ranking.alias("action_ranking"))
    best = F.col("action_ranking")[0]
    return ranked.select(
        "segment_id",
        best["action_type"].alias("recommended_action"),
        best["conversion_lift"].alias("predicted_conversion_lift"),
        best["net_value_usd"].alias("predicted_net_value_usd"),
        "action_ranking",
        F.lit(scored_at).cast("timestamp_ntz").alias("scored_at"),
    )


def recommendations(
    open_rows: DataFrame,
    scored_at: str,
    rule: ActionRule = ActionRule(),
    per_conversion: float = REVENUE_PER_CONVERSION,
) -> DataFrame:
    return recommend(with_net_value(action_candidates(open_rows, rule), per_conversion), scored_at)


def ranking_json(ranking: Column) -> Column:
    return F.to_json(ranking)


def parse_ranking(text: Column) -> Column:
    """Ranking text to an array. Text that was encoded twice is decoded twice; anything malformed gives an empty array."""
    inner = F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")).otherwise(text)
    parsed = F.from_json(inner, RANKING_TYPE)
    objects = F.filter(parsed, lambda o: o.isNotNull())
    return F.coalesce(F.when(F.ltrim(inner).startswith("["), objects), F.array().cast(RANKING_TYPE))


def gold_outcomes(silver: DataFrame) -> DataFrame:
    return silver.select(
        "segment_id", "cohort", "platform", "action_type", "had_matching_experiment", "conversion_at_action",
        "initiated_date", "ship_cost_usd", "conversion_lift", "users_recovered",
    )


def action_mix(recs: DataFrame, positions: DataFrame) -> DataFrame:
    """Per recommended action: segments, total lift, total net value and the yearly value of the lift."""
    value = F.col("predicted_conversion_lift") * F.col("mau") * F.lit(REVENUE_PER_CONVERSION) * F.lit(12.0)
    joined = recs.join(positions.select("segment_id", "mau"), "segment_id")
    return joined.groupBy("recommended_action").agg(
        F.count(F.lit(1)).alias("segments"),
        F.round(F.sum("predicted_conversion_lift"), 6).alias("total_lift"),
        F.round(F.sum("predicted_net_value_usd"), 3).alias("total_net_value_usd"),
        F.round(F.sum(value), 3).alias("annual_recovery_usd"),
    )


def recommendation_table(recs: DataFrame, positions: DataFrame) -> DataFrame:
    out = recs.join(positions.select("segment_id", "cohort", "platform"), "segment_id")
    return out.select(
        "segment_id", "cohort", "platform", "recommended_action", "predicted_conversion_lift",
        "predicted_net_value_usd",
    ).orderBy(F.col("predicted_net_value_usd").desc_nulls_last(), "segment_id")


def flag_rollout_queue(recs: DataFrame, open_rows: DataFrame) -> DataFrame:
    rollouts = recs.where(F.col("recommended_action") == "rollout_existing_flag")
    context = open_rows.select(
        "segment_id", "cohort", "platform", "mau", "conversion_drop", "conversion_at_risk_usd",
        "has_matching_experiment", "neighbor_flag_key",
    )
    return rollouts.select("segment_id", "predicted_conversion_lift", "predicted_net_value_usd").join(
        context, "segment_id"
    )


def lift_coefficients(outcomes: DataFrame) -> DataFrame:
    """Mean lift and lift per 1000 USD by action and match. Lifts are summed as decimals, so the sum is exact."""
    lift = F.col("conversion_lift").cast("decimal(18,6)")
    cost = F.col("ship_cost_usd").cast("decimal(18,2)")
    sums = outcomes.groupBy("action_type", "had_matching_experiment").agg(
        F.count(F.lit(1)).alias("outcomes"),
        F.sum(lift).cast("double").alias("lift_sum"),
        F.sum(cost).cast("double").alias("cost_sum"),
    )
    return sums.select(
        "action_type", "had_matching_experiment", "outcomes",
        (F.col("lift_sum") / F.col("outcomes")).alias("mean_lift"),
        (F.col("lift_sum") / F.col("cost_sum") * 1000.0).alias("lift_per_1000_usd"),
    )


def seed_forecast(forecasts: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the rows of segments that have no forecast yet; the existing rows stay."""
    missing = rows.join(forecasts.select("segment_id").distinct(), "segment_id", "left_anti")
    return forecasts.unionByName(missing)
