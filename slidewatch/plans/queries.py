"""The registered queries: every operator of the library over the given tables.

Dates and timestamps are shown as text and decimals as doubles, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidewatch.functions import exprs as X
from slidewatch.functions.scan import row_position
from slidewatch.functions.schema import struct
from slidewatch.operators import cdc, chat, commerce, gold, joins, metrics, model, quality, rank, search, silver, usage
from slidewatch.operators import decisions as D
from slidewatch.plans.sample_data import (
    ANCHOR,
    AS_OF,
    BANDS,
    GATEWAYS,
    SCORED_AT,
    Tables,
)
from slidewatch.session import work_path
from slidewatch.settings import ALERT_USD, FEATURE_AREAS, HARD_STOP_USD
from slidewatch.sources import named_queries, tables, versions
from slidewatch.streaming import log, mirror, rollups, stateful

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}

SEGMENT = "SEG-0000022"
SEARCH_TEXT = "that there will be a checkout of the thing, les mentions"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def present(df: DataFrame) -> DataFrame:
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(field.name))
    return df.select(*out)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return present(QUERIES[name](Tables(spark, folder)))


def options_text(ranking):
    """A ranking as short text: actions and whole-dollar net values, in order."""
    one = lambda o: F.concat_ws(":", o["action_type"], F.round(o["net_value_usd"]).cast("long").cast("string"))
    return F.array_join(F.transform(ranking, one), ",")


def trail_text():
    """A page of a trail as short text: actions and who took them, in order."""
    return F.array_join(F.transform("audit_trail", lambda e: F.concat_ws("/", e["action"], e["by"])), ",")


# -- sources and sinks -------------------------------------------------------------------------------------------


@query
def raw_read(t):
    raw = tables.read_raw(t.spark, t.folder, "raw_events", suffix=".parquet")
    return raw.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def save_and_verify(t):
    return tables.save_verified(t.segments, work_path(t.spark, "segments")).select("row_count")


@query
def publish_positions(t):
    columns = {
        "segment_id": None, "cohort": None, "platform": None, "region": None, "segment_summary": None, "mau": None,
        "conversion_rate": None, "conversion_rate_3w_ago": None, "conversion_drop": None, "sessions": None,
        "slide_signal_score": "double", "conv_band": None, "conversion_at_risk_usd": None,
    }
    return versions.publish_version(t.position, work_path(t.spark, "sync_positions"), columns, "segment_id")


@query
def publish_experiments(t):
    columns = dict.fromkeys(t.experiments.columns)
    return versions.publish_version(t.experiments, work_path(t.spark, "sync_experiments"), columns, "experiment_id")


@query
def publish_open_sliding(t):
    columns = dict.fromkeys(
        ["segment_id", "cohort", "platform", "region", "mau", "conversion_rate", "conversion_drop", "conversion_at_risk_usd", "conv_band",
         "has_matching_experiment", "matching_experiment_id", "matching_experiment_lift", "neighbor_flag_key"]
    )
    return versions.publish_version(t.open_rows, work_path(t.spark, "sync_open_sliding"), columns, "segment_id")


@query
def publish_recommendations(t):
    columns = dict.fromkeys(["segment_id", "recommended_action", "predicted_conversion_lift", "predicted_net_value_usd", "action_ranking"])
    table = versions.publish_version(t.recs, work_path(t.spark, "sync_recommendations"), columns, "segment_id")
    return table.withColumn("action_ranking", options_text("action_ranking"))


@query
def sync_only_when_empty(t):
    path = work_path(t.spark, "mirror")
    first = tables.sync_once(t.position, path)
    second = tables.sync_once(t.position, path)
    forced = tables.sync_once(t.position.where("conv_band <> 'healthy'"), path, force=True)
    counted = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select("*", F.lit(first).alias("first"), F.lit(second).alias("second"), F.lit(forced).alias("forced"))


@query
def append_new_keys(t):
    path = work_path(t.spark, "segments")
    known = t.segments.where("platform <> 'web'").withColumn("region", F.lit("KEPT"))
    known.write.parquet(path)
    return tables.append_new(t.segments, path, "segment_id").select("segment_id", "platform", "region")


@query
def optional_source(t):
    schema = struct(segment_id="string", recommended_action="string")
    missing = tables.read_optional(t.spark, work_path(t.spark, "not_there"), schema)
    return t.open_rows.join(missing, "segment_id", "left").select("segment_id", "recommended_action")


@query
def reset_everything(t):
    """All decisions go and every mirror is filled again from its source."""
    sources = {"segment_positions": t.position, "open_sliding": t.open_rows, "experiments": t.experiments}
    paths = {name: work_path(t.spark, f"mirror_{name}") for name in sources}
    decisions = work_path(t.spark, "decisions")
    t.decisions.write.parquet(decisions)
    for name in sources:
        sources[name].limit(1).write.parquet(paths[name])  # what an earlier, partial sync left
    names = tables.reset_mirrors(t.spark, sources, paths, decisions, t.decisions.schema)
    mirrors = {name: t.spark.read.parquet(paths[name]) for name in names}
    return tables.mirror_counts({**mirrors, "decisions": t.spark.read.parquet(decisions)})


@query
def reset_one_segment(t):
    kept, deleted = D.reset_decisions(t.decisions, SEGMENT)
    left = kept.agg(F.count(F.lit(1)).alias("remaining"))
    return joins.attach_scalar(left, deleted)


@query
def mirror_row_counts(t):
    return tables.mirror_counts(
        {
            "segment_positions": t.position, "open_sliding": t.open_rows, "action_recommendations": t.recs,
            "experiments": t.experiments,
        }
    )


def _commerce_views(t):
    t.returns(product=True).createOrReplaceTempView("silver_returns")
    t.items().createOrReplaceTempView("silver_order_items")
    t.lots.createOrReplaceTempView("raw_production_lots")
    t.products.createOrReplaceTempView("raw_products")


@query
def named_daily_refund_trend(t):
    _commerce_views(t)
    return named_queries.run_query(t.spark, "daily_refund_trend", as_of="2001-01-01")


@query
def named_returns_by_product(t):
    _commerce_views(t)
    return named_queries.run_query(t.spark, "returns_by_product")


@query
def named_worst_lots(t):
    _commerce_views(t)
    return named_queries.run_query(t.spark, "worst_lots")


@query
def numeric_coercion(t):
    cells = t.raw("events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("kind"),
        F.concat(F.lit("-"), F.col("user_id").cast("string"), F.lit(".50")).alias("shown"),
        F.concat(F.col("user_id").cast("string"), F.lit("-1")).alias("code"),
    )
    return X.coerce_numeric(cells, ["k", "kind", "shown", "code"]).select("event_id", "k_num", "kind_num", "shown_num", "code_num")


# -- projections and filters -------------------------------------------------------------------------------------


@query
def business_keys(t):
    return t.raw("part").select("p_partkey", X.format_id("EXP-", "p_partkey", 7).alias("experiment_id"))


@query
def membership_flags(t):
    return t.raw("part").select("p_partkey", X.in_set(F.col("p_size"), [1, 5, 8, 13, 21]).alias("is_member"))


@query
def dictionary_picks(t):
    return t.raw("part").select("p_partkey", X.pick(FEATURE_AREAS, F.col("p_size") % 4).alias("area"))


@query
def case_assignments(t):
    balance = F.col("c_acctbal")
    grade = X.case_assign([(balance < 0, "debt"), (balance < 3000, "low"), (balance < 7000, "mid")], "high")
    return t.raw("customer").select("c_custkey", grade.alias("grade"))


@query
def segment_texts(t):
    return t.segments.select("segment_id", "cohort", "platform", "region", "mau", "segment_summary", "is_active")


@query
def experiment_texts(t):
    return t.experiments


@query
def date_offsets(t):
    return t.raw("part").select("p_partkey", X.days_before(F.lit(ANCHOR).cast("date"), F.col("p_size")).alias("day"))


@query
def ramp_values(t):
    days = F.col("p_size") % 31
    return t.raw("part").select("p_partkey", days.alias("days_ago"), X.ramp(days, 31, 0.042, -0.013).alias("rate"))


@query
def conversion_bands(t):
    return t.position.select(
        "segment_id",
        X.conversion_drop("conversion_rate_3w_ago", "conversion_rate").alias("conversion_drop"),
        X.conv_band("conversion_drop", "conversion_rate").alias("default_band"),
        X.conv_band("conversion_drop", "conversion_rate", BANDS).alias("band"),
    )


@query
def value_at_risk(t):
    return t.position.select("segment_id", X.at_risk("mau", "conversion_drop", "conv_band").alias("at_risk_usd"))


@query
def cell_slice(t):
    return metrics.slice_rows(t.position, platform="android", band="watch").select("segment_id", "cohort", "platform", "conv_band")


@query
def id_search(t):
    return rank.search_cases(t.position, " seg-00000 ").select("segment_id")


@query
def queue_search(t):
    return rank.search_cases(t.position, "MACHIN", ["segment_id", "cohort", "platform"]).select("segment_id", "cohort")


def _queue(t):
    return t.live(limit=None)


@query
def queue_tabs(t):
    latest = D.latest_decision(t.decisions).select("segment_id", F.col("status").alias("decision_status"))
    rows = t.open_rows.select("segment_id", "conv_band", "has_matching_experiment").join(latest, "segment_id", "left")
    return rank.queue_tabs(rows).select("segment_id", "tab")


@query
def rollout_forecasts(t):
    rows = t.position.join(t.recs, "segment_id").select("segment_id", "conversion_rate", "predicted_conversion_lift")
    what_if = joins.cross_with_list(rows, "pct", [25, 50, 100])
    return what_if.select(
        "segment_id", "pct",
        F.round(X.rollout_forecast("conversion_rate", "predicted_conversion_lift", "pct"), 8).alias("predicted_rate"),
    )


@query
def bounded_page(t):
    return rank.bounded_limit(rank.sort_queue(t.position, "mau"), 500, 40).select("segment_id", "mau")


# -- silver ------------------------------------------------------------------------------------------------------


@query
def note_flags(t):
    return silver.note_slide_flags(t.snapshots)


@query
def silver_daily_events(t):
    return t.silver_events.withColumn("revenue", F.round("revenue", 2))


@query
def silver_conversion(t):
    return t.silver_conv


@query
def current_flags(t):
    return silver.silver_flags(t.flags)


@query
def silver_outcome_counts(t):
    return t.silver_outcomes.groupBy("cohort", "platform", "region", "action_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("users_recovered").cast("long")).alias("users"),
        F.min("initiated_date").alias("first_day"),
    )


def _event_rules():
    return {
        "positive_value": F.col("value") >= 1,
        "known_type": F.col("event_type").isin("view", "click", "purchase", "signup"),
        "low_k": F.get_json_object("props", "$.k").cast("int") < 90,
    }


@query
def expectations_drop(t):
    kept, _ = silver.expect(t.raw("events"), _event_rules(), "drop")
    return kept.select("event_id", "event_type")


@query
def expectation_counts(t):
    _, counted = silver.expect(t.raw("events"), _event_rules(), "warn")
    return counted


# -- gold --------------------------------------------------------------------------------------------------------


@query
def segment_position(t):
    return t.build_position()


@query
def open_sliding(t):
    return t.build_open()


@query
def experiment_matches(t):
    matched = gold.match_experiment(t.position, t.experiments)
    return matched.select("segment_id", "has_matching_experiment", "matching_experiment_id", "matching_experiment_lift")


@query
def neighbor_flags(t):
    near = gold.neighbor_flag(t.position, t.silver_flags, t.segments)
    return near.select("segment_id", "neighbor_flag_key", "neighbor_variant", "neighbor_segment_id")


@query
def action_options(t):
    return gold.action_candidates(t.open_rows).select("segment_id", "action_type", "conversion_lift", "ship_cost_usd")


@query
def net_values(t):
    scored = gold.with_net_value(gold.action_candidates(t.open_rows))
    return scored.select("segment_id", "action_type", "net_value_usd")


@query
def action_recommendations(t):
    recs = gold.recommendations(t.open_rows, SCORED_AT)
    return recs.withColumn("action_ranking", options_text("action_ranking"))


@query
def parsed_rankings(t):
    """Rankings written as text, some doubly encoded or damaged, and read again."""
    number = F.substring_index("segment_id", "-", -1).cast("long")
    text = gold.ranking_json(F.col("action_ranking"))
    damaged = (
        F.when(number % 5 == 0, F.lit("{not json")).when(number % 5 == 1, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"')))
        .when(number % 5 == 2, F.lit(None).cast("string")).otherwise(text)
    )
    parsed = t.recs.select("segment_id", gold.parse_ranking(damaged).alias("r"))
    return parsed.select("segment_id", F.size("r").alias("options"), options_text("r").alias("ranking"))


@query
def outcome_rows(t):
    rows = gold.gold_outcomes(t.silver_outcomes)
    return rows.groupBy("segment_id", "action_type", "had_matching_experiment", "conversion_at_action").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("conversion_lift").cast("decimal(18,4)")).alias("lift"),
        F.sum(F.col("users_recovered").cast("long")).alias("users"),
    )


@query
def action_mix(t):
    return gold.action_mix(t.recs, t.position)


@query
def recommendation_table(t):
    return gold.recommendation_table(t.recs, t.position)


@query
def flag_rollout_queue(t):
    return gold.flag_rollout_queue(t.recs, t.open_rows)


@query
def lift_coefficients(t):
    return gold.lift_coefficients(t.outcomes)


@query
def forecast_seed(t):
    known = t.position.where("platform = 'ios'").select("segment_id", F.lit(0.01).alias("forecast_lift"), F.lit("known").alias("rationale"))
    rows = t.open_rows.where("has_matching_experiment").select(
        "segment_id", F.col("matching_experiment_lift").alias("forecast_lift"), F.lit("proven").alias("rationale")
    )
    return gold.seed_forecast(known, rows)


# -- joins -------------------------------------------------------------------------------------------------------


@query
def inner_join(t):
    return joins.join_inner(t.position.select("segment_id", "mau"), t.open_rows.select("segment_id", "has_matching_experiment"), "segment_id")


@query
def left_join(t):
    return joins.join_left(t.position.select("segment_id"), t.recs.select("segment_id", "recommended_action"), "segment_id")


@query
def full_join(t):
    a = t.raw("documents").select("doc_id", "lang")
    b = t.raw("embeddings").select((F.col("vec_id") * 3).alias("doc_id"), F.col("label").alias("vec_label"))
    return joins.join_full(a, b, "doc_id")


@query
def anti_join(t):
    return joins.join_anti(t.segments.select("segment_id", "cohort"), t.daily.select("segment_id"), "segment_id")


@query
def semi_join(t):
    return joins.join_semi(t.segments.select("segment_id", "cohort"), t.daily.select("segment_id"), "segment_id")


@query
def list_cross(t):
    return joins.cross_with_list(t.segments.select("segment_id"), "feature_area", FEATURE_AREAS)


@query
def dimension_join(t):
    joined = joins.broadcast_dim(t.events, t.segments.select("segment_id", "cohort", "region"), "segment_id")
    return joined.groupBy("cohort", "region").agg(F.count(F.lit(1)).alias("sessions"))


@query
def scalar_join(t):
    total = t.daily.agg(F.sum("sessions").cast("long").alias("all_sessions"))
    return joins.attach_scalar(t.position.select("segment_id", "sessions"), total)


@query
def composite_join(t):
    proven = gold.best_proven(t.experiments)
    return joins.join_multi(t.segments.select("segment_id", "cohort", "platform"), proven, ["cohort", "platform"])


@query
def proven_fixes(t):
    return joins.proven_fixes(t.open_rows, t.experiments)


# -- metrics -----------------------------------------------------------------------------------------------------


def _rounded(df):
    return df.withColumns({c: F.round(c, 8) for c in ("avg_conversion", "avg_slide_signal") if c in df.columns})


@query
def segment_metrics_all(t):
    return _rounded(metrics.segment_metrics(t.position))


@query
def segment_metrics_by_cohort_platform(t):
    return _rounded(metrics.segment_metrics(t.position, ["cohort", "platform"]))


@query
def segment_metrics_sliding(t):
    return _rounded(metrics.segment_metrics(t.position, ["region"], {"conv_band": "sliding"}))


@query
def stored_metrics_rollup(t):
    stored = metrics.store_metrics(t.position, work_path(t.spark, "segment_metrics"))
    return _rounded(metrics.rollup_from(stored, ["platform", "region"]))


@query
def refreshed_metrics_rollup(t):
    """The stored aggregate after segments came, changed and went: kept up by what changed, not built again.

    Before, sliding segments were healthy, watched ones were not there, and healthy ones had a second, retired row.
    """
    now = t.position
    band = F.col("conv_band")
    were = now.where(band == "sliding").withColumn("conv_band", F.lit("healthy"))
    retired = now.where(band == "healthy").withColumn("cohort", F.lit("RETIRED"))
    table = metrics.metrics_table(t.spark, work_path(t.spark, "kept_metrics"))
    metrics.refresh_metrics(table, now.limit(0), now.where(band == "healthy").unionByName(were).unionByName(retired), 0)
    metrics.refresh_metrics(table, were.unionByName(retired), now.where(band.isin("sliding", "watch")), 1)
    return _rounded(metrics.rollup_from(metrics.stored_metrics(table), ["platform", "region"]))


@query
def dashboard_conv(t):
    return _rounded(metrics.dashboard_conv(t.position))


@query
def kpi_cards(t):
    row = metrics.kpis(t.position)
    return row.withColumns({c: F.round(c, 8) for c in ("avg_conversion_healthy", "avg_conversion_sliding", "conversion_gap")})


@query
def slide_mix_by_platform(t):
    return metrics.slide_mix_by_platform(t.position)


@query
def slide_mix_pivot(t):
    return metrics.slide_mix_pivot(t.position)


@query
def at_risk_by_cohort(t):
    return metrics.at_risk_by_cohort(t.position)


@query
def sliding_profile(t):
    return metrics.sliding_profile(t.position)


@query
def conversion_trend(t):
    return _rounded(metrics.conversion_trend(t.conv, t.position, "week", AS_OF))


@query
def segment_sparkline(t):
    return metrics.segment_trend(t.daily, SEGMENT, AS_OF)


@query
def scatter_points(t):
    number = F.substring_index("segment_id", "-", -1).cast("long") * 7919
    return metrics.scatter_points(t.position, number)


@query
def modal_region(t):
    return metrics.mode_by(t.items(), "lot_id", "region")


@query
def first_region(t):
    return metrics.first_after_agg(t.items(), "lot_id", "region")


@query
def conversion_share(t):
    return metrics.conversion_share(t.daily, ["cohort", "platform"])


@query
def conditional_counts(t):
    return t.raw("events").groupBy("user_id").agg(
        X.count_if(F.col("event_type") == "error").alias("errors"),
        X.count_if(F.col("value") > 20).alias("large"),
    )


@query
def note_dedup_ratio(t):
    return metrics.dedup_ratio(t.snapshots, "pm_note_text")


# -- ranking and sets --------------------------------------------------------------------------------------------


@query
def risk_ranks(t):
    return rank.risk_rank(t.open_rows).select("segment_id", "conversion_at_risk_usd", "risk_rank")


@query
def latest_order_per_customer(t):
    return rank.latest_per_key(t.orders, "customer_id", ["order_date", "order_id"])


@query
def ranked_candidates(t):
    return rank.rank_candidates(t.experiments.select("experiment_id", "observed_lift"), "observed_lift", "experiment_id", 50)


@query
def worst_sliding(t):
    return rank.worst_sliding(t.position)


@query
def watch_list(t):
    return rank.watch_list(t.position)


@query
def worst_segment(t):
    return rank.worst_segment(t.open_rows).select("segment_id", "conversion_at_risk_usd", "neighbor_flag_key")


@query
def sorted_queue(t):
    return rank.sort_queue(t.open_rows, "drop").select("segment_id", "conversion_drop")


@query
def nulls_last(t):
    return rank.sort_nulls_last(t.position.select("segment_id", "slide_signal_score"), "slide_signal_score", "segment_id").limit(20)


@query
def union_by_name(t):
    a = t.position.where("conv_band = 'watch'").select("segment_id", "conv_band")
    b = t.position.where("conv_band = 'sliding'").select("conv_band", "segment_id")
    return rank.union_by_name(a, b)


@query
def union_counts(t):
    return rank.union_counts({"segments": t.segments, "flags": t.flags, "snapshots": t.snapshots})


@query
def distinct_notes(t):
    return rank.distinct_values(t.snapshots, "pm_note_text")


# -- search ------------------------------------------------------------------------------------------------------


@query
def bm25_documents(t):
    return search.bm25_search(t.raw("documents"), SEARCH_TEXT, 20, "doc_id", "text")


@query
def bm25_experiments(t):
    return search.bm25_search(t.experiments, "checkout improvements that WON for BUILDING android", 20)


@query
def nearest_vectors(t):
    return search.vector_search(t.raw("embeddings"), t.query_vector, 50, "vec_id", "embedding")


@query
def hybrid_documents(t):
    found = search.hybrid_search(
        t.raw("documents"), SEARCH_TEXT, t.query_vector, 20, "doc_id", "text", "embedding", vectors=t.vectors
    )
    return found.select("doc_id", "vector_rank", "bm25_rank", F.round("fused_relevance", 10).alias("fused_relevance"))


@query
def fused_ranks(t):
    near = rank.rank_candidates(
        search.vector_distances(t.raw("embeddings"), t.query_vector, "vec_id", "embedding"), "distance", "vec_id", 50, ascending=True
    )
    labelled = rank.rank_candidates(t.raw("embeddings").select("vec_id", "label"), "label", "vec_id", 50)
    fused = search.rrf(near, labelled, "vec_id", 100)
    return fused.withColumn("fused_relevance", F.round("fused_relevance", 10))


@query
def vector_dimensions(t):
    return search.dim_report(search.check_dim(t.raw("embeddings"), "embedding", 64), "embedding", 64)


@query
def grounded_segments(t):
    return search.ground_segments(t.open_rows, t.experiments)


@query
def experiment_lookup(t):
    return search.find_experiment(t.experiments, "EXP-0000009").select("experiment_id", "experiment_name", "won")


# -- live view and decisions -------------------------------------------------------------------------------------


@query
def live_view(t):
    live = t.live()
    return live.withColumn("action_ranking", options_text("action_ranking"))


@query
def live_view_of_segment(t):
    return t.live(SEGMENT, 1).select("segment_id", "risk_rank", "decision_id", "decision_status")


@query
def case_list(t):
    return D.cases(t.open_rows, t.decisions).select("segment_id", "decision_id", "decision_status", "decided_at", "decision_created_at")


@query
def case_details(t):
    found = D.case_detail(t.decisions, _queue(t), t.experiments, t.trails)
    return found.select(
        "decision_id", "segment_id", "status", "action_type", "risk_rank", "conversion_drop", "target_experiment_id", "experiment_name",
        "observed_lift", "experiment_text", "page", F.size("audit_trail").alias("entries"), trail_text().alias("trail"),
    )


@query
def next_cases(t):
    """Segments to look at next, where one still under review counts as taken."""
    under_review = t.decisions.where("status = 'proposed'")
    return D.next_cases(t.open_rows, t.recs, under_review, 10)


@query
def checked_transitions(t):
    return D.validate_transitions(t.decision_events).select("event_id", "decision_id", "action", "valid", "reason")


@query
def rejected_transitions(t):
    return D.split_transitions(t.decision_events)[1].groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def folded_decisions(t):
    return D.fold_decisions(t.valid_events)


@query
def audit_rows(t):
    return D.audit_entries(t.valid_events).select("decision_id", "position", "at", "by", "action", "tool")


@query
def audit_trails(t):
    return t.trails.select("decision_id", "page", F.size("audit_trail").alias("entries"), trail_text().alias("trail"))


@query
def assist_runs(t):
    return D.assist_run(t.trails)


@query
def activity_feed(t):
    emails = t.decisions.where("status = 'committed'").select(
        "decision_id", F.col("decided_at").alias("at"), F.lit("mailer").alias("by"), F.lit("Decision shipped").alias("subject")
    )
    return D.activity(t.trails, 25, emails)


@query
def decision_rule_counts(t):
    _, counted = silver.expect(t.decisions, D.decision_rules(), "warn")
    return counted


def _redrafts(t):
    return t.decision_events.where("action = 'redrafted'").select("decision_id", "at", "drafted_note", "assist_run_id")


@query
def redrafted_decisions(t):
    applied, entries, _ = D.apply_redrafts(t.decisions, _redrafts(t))
    added = entries.groupBy("decision_id").agg(F.count(F.lit(1)).alias("redrafts"))
    return applied.join(added, "decision_id", "left").select(
        "decision_id", "status", "drafted_note", F.coalesce("redrafts", F.lit(0)).cast("long").alias("redrafts")
    )


@query
def redrafted_trails(t):
    """Trails in which every accepted redraft is an entry of its own."""
    start = D.audit_entries(t.valid_events.where("action <> 'redrafted'"))
    whole = D.extend_trail(start, D.apply_redrafts(t.decisions, _redrafts(t))[1])
    return whole.select("decision_id", "position", "at", "action", "assist_run_id")


@query
def refused_redrafts(t):
    return D.apply_redrafts(t.decisions, _redrafts(t))[2].select("decision_id", "assist_run_id")


@query
def kpis_after_decisions(t):
    return D.kpi_after_decisions(t.position, t.decisions)


@query
def change_history(t):
    return cdc.scd2(t.changes, "business_key", F.floor(F.col("_pg_lsn") / (10**12 * 30))).select(
        "business_key", "_pg_lsn", "_pg_change_type", "status", "amount", "valid_from", "valid_to", "is_current"
    )


@query
def current_rows(t):
    return cdc.current_from_cdc(t.changes, "business_key").select("business_key", "_pg_lsn", "status", "amount")


@query
def rows_as_of(t):
    history = cdc.scd2(t.changes, "business_key", F.floor(F.col("_pg_lsn") / (10**12 * 30)))
    return cdc.state_as_of(history, "1998-01-01 00:00:00").select("business_key", "_pg_lsn", "status", "amount")


@query
def decision_cycle_times(t):
    return D.cycle_times(t.valid_events)


@query
def view_freshness(t):
    return D.freshness(_queue(t), t.decisions, SCORED_AT)


@query
def ranking_top_options(t):
    text = t.recs.select("segment_id", gold.ranking_json(F.col("action_ranking")).alias("action_ranking"))
    return D.top_option(text).withColumn("net_value_usd", F.round("net_value_usd", 4))


# -- model -------------------------------------------------------------------------------------------------------


@query
def model_training_rows(t):
    return model.training_rows(t.outcomes).drop("matched")


@query
def model_recommendations(t):
    fitted = model.train_lift(t.outcomes)
    return model.score_actions(fitted, t.open_rows, SCORED_AT).withColumn("action_ranking", options_text("action_ranking"))


@query
def model_metrics(t):
    learn, judge = model.split_outcomes(t.outcomes)
    return model.lift_metrics(model.train_lift(learn), judge)


@query
def model_facts(t):
    """What holds of the learned recommendations whatever the trees look like; see ``model.facts``."""
    learn, judge = model.split_outcomes(t.outcomes)
    fitted = model.train_lift(learn)
    return model.facts(model.score_actions(fitted, t.open_rows, SCORED_AT), model.lift_metrics(fitted, judge), judge)


@query
def model_trials(t):
    return model.tune_lift(t.outcomes)


@query
def learned_note_labels(t):
    return model.classify_notes(model.train_note_classifier(t.snapshots), t.snapshots)


# -- AI usage ----------------------------------------------------------------------------------------------------


@query
def usage_rows(t):
    return t.usage_base


@query
def usage_summary(t):
    return usage.usage_summary(t.usage_base, t.spend, list(GATEWAYS))


@query
def usage_summary_without_spend(t):
    return usage.usage_summary(t.usage_base, t.spend, ["svc.none"])


@query
def usage_hourly(t):
    return usage.usage_hourly(t.usage_base)


@query
def usage_by_model(t):
    return usage.usage_by_model(t.usage_base)


@query
def request_log(t):
    return usage.request_log(t.usage_base)


@query
def running_costs(t):
    return usage.running_cost(t.usage_base).drop("est_cost_usd")


@query
def budget_states(t):
    return usage.budget_state(t.usage_base)


def _policy_requests(t):
    return t.payload.select(
        "request_id", F.when(F.col("api_type") == "/v1/user", F.lit("request")).otherwise(F.lit("response")).alias("type"),
        F.concat("request", "response").alias("message"),
    )


@query
def policy_verdicts(t):
    return usage.evaluate_policy(_policy_requests(t)).select("request_id", "type", "result", "policy_reason")


@query
def policy_function(t):
    usage.create_policy_function(t.spark)
    event = F.to_variant_object(F.struct("type", F.struct("message").alias("context")))
    events = _policy_requests(t).select("request_id", event.alias("event"))
    verdict = events.select("request_id", F.expr("block_unbounded_read(event)").alias("v"))
    return verdict.select("request_id", F.expr("variant_get(v, '$.result', 'string')").alias("result"))


@query
def marker_rows(t):
    return usage.find_marker(t.payload, "MARK-1 ", "2024-01-03 00:00:00", hours=48, n=1)


@query
def decision_costs(t):
    return usage.cost_per_decision(t.usage_base, t.decisions)


@query
def latency_by_service(t):
    return usage.latency_summary(t.payload).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


# -- commerce ----------------------------------------------------------------------------------------------------


@query
def daily_refund_trend(t):
    return commerce.daily_refund_trend(t.returns(), "1998-08-31")


@query
def returns_by_product(t):
    return commerce.returns_by_product(t.returns(product=True))


@query
def worst_lots(t):
    return commerce.worst_lots(t.lots, t.products, t.items(), t.returns())


@query
def returns_summary(t):
    return commerce.returns_summary(t.returns())


@query
def city_breakdown(t):
    cities = commerce.city_breakdown(t.returns(customer=True), t.customers, t.tiers)
    return cities.withColumns({"lat": F.round("lat", 9), "lng": F.round("lng", 9)})


@query
def facility_summary(t):
    return commerce.facility_summary(t.returns(place=True))


@query
def facility_lots(t):
    return commerce.facility_lots(t.returns(product=True, place=True))


@query
def one_facility_lots(t):
    return commerce.facility_lots(t.returns(product=True, place=True), "NATION_3")


@query
def customer_orders(t):
    return commerce.customer_orders(t.orders, t.items())


@query
def one_customer_orders(t):
    return commerce.customer_orders(t.orders, t.items(), 7)


@query
def return_queue(t):
    queue = commerce.list_returns(t.returns(customer=True), t.tiers, t.customers, status="pending", tier="premium", sort="anger")
    return queue.select("return_id", "anger_score", "final_tier", "premium_status_labeled", "premium_prob", "return_date")


@query
def return_queue_by_value(t):
    queue = commerce.list_returns(t.returns(customer=True), t.tiers, t.customers, country="NATION_5", sort="value", n=None)
    return queue.select("return_id", "refund_amount_usd", "final_tier", "status")


@query
def lot_summary(t):
    return commerce.lot_summary(t.returns())


@query
def country_breakdown(t):
    return commerce.country_breakdown(t.returns(customer=True), t.customers, t.tiers)


@query
def tier_breakdown(t):
    return commerce.tier_breakdown(t.returns(customer=True), t.customers, t.tiers)


OFFERS = {"premium": 30, "standard": 10}


def _offers(t, lot):
    return commerce.apply_tier_offers(t.returns(customer=True), t.tiers, lot, OFFERS, SCORED_AT, "agent")


@query
def tier_offers(t):
    return _offers(t, 77).where("lot_id = 77").select(
        "return_id", "status", "coupon_pct_applied", "applied_tier", F.size("audit_trail").alias("entries")
    )


@query
def tier_offer_effects(t):
    """All lots after the offer on one of them: the others keep status, coupon and trail."""
    rows = _offers(t, 77).withColumn("chosen", F.col("lot_id") == 77)
    return rows.groupBy("chosen", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count("coupon_pct_applied").alias("coupons"), F.count("applied_tier").alias("changed"),
        F.sum(F.size("audit_trail")).alias("entries"), F.round(F.sum("refund_amount_usd"), 2).cast("double").alias("total_usd"),
    )


@query
def tier_offer_summary(t):
    return commerce.offer_summary(_offers(t, None))


@query
def tier_offer_skips(t):
    attempted = t.returns().where("lot_id = 77")
    return commerce.skipped_returns(attempted, _offers(t, 77))


@query
def decided_returns(t):
    made = t.returns().where("status = 'escalated'").select(
        "return_id",
        F.when(F.col("quantity") > 25, F.lit("approved")).otherwise(F.lit("rejected")).alias("decision"),
        F.lit(SCORED_AT).cast("timestamp_ntz").alias("at"), F.lit("manager").alias("by"), F.lit("").alias("notes"),
    )
    decided = commerce.decide_returns(t.returns(), made)
    return decided.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("audit_trail")).alias("entries"),
        F.round(F.sum("refund_amount_usd"), 2).alias("total_usd"), X.count_if(F.col("decided_at").isNotNull()).alias("decided"),
    )


# -- chat --------------------------------------------------------------------------------------------------------


@query
def conversation_list(t):
    return chat.conversation_list(t.conversations)


@query
def transcripts(t):
    return chat.transcript(t.conversations, t.messages).select("conversation_id", "user_email", "position", "role", F.length("content").alias("chars"))


@query
def appended_messages(t):
    incoming = t.messages.where("role = 'user'").select(
        (F.col("conversation_id") * (F.col("conversation_id") % 2 * 1000000 + 1)).alias("conversation_id"),
        F.col("position").alias("sequence"), "role", "content",
    )
    return chat.append_messages(t.messages, incoming, block=2).select("conversation_id", "sequence", "role", "position")


@query
def feedback_votes(t):
    return chat.feedback_rollup(t.feedback, t.messages)


@query
def deleted_conversations(t):
    gone = t.conversations.where("user_email LIKE 'user-1%'")
    left = chat.delete_conversations(t.conversations, t.messages, t.feedback, gone)
    return rank.union_counts(dict(zip(("conversations", "messages", "feedback"), left, strict=True)))


# -- streams -----------------------------------------------------------------------------------------------------


def _event_stream(t):
    schema = t.raw("events").schema
    return rollups.file_stream(t.spark, t.folder, schema, names="events.parquet")


def _run(stream, t, name, mode="update"):
    path = work_path(t.spark, name)
    log.run_available(stream, path, work_path(t.spark, f"{name}-checkpoint"), mode)
    return path


@query
def stream_daily_events(t):
    daily = rollups.stream_silver_events(t.sessions(_event_stream(t)))
    path = work_path(t.spark, "stream-daily")
    rollups.run_silver_events(daily, lambda spark: Tables(spark, t.folder).segments, path, work_path(t.spark, "stream-daily-checkpoint"))
    out = rollups.read_silver_events(t.spark, path, t.segments)
    return out.withColumn("revenue", F.round("revenue", 2))


@query
def stream_hourly_usage(t):
    base = usage.usage_base(t.usage_rows(_event_stream(t)), GATEWAYS)
    hourly = rollups.stream_usage_hourly(mirror.as_ltz(base, "event_time"))
    path = _run(hourly, t, "stream-hourly")
    out = log.read_latest(t.spark, path, rollups.HOURLY_SCHEMA, ["hour", "gateway"])
    return out.select("hour", "gateway", F.round("cost", 6).alias("est_cost_usd"), "total_tokens", "requests")


@query
def stream_mirror(t):
    changes = _change_files(t)
    stream = rollups.file_stream(t.spark, changes, t.changes.schema, files_per_trigger=4)
    path = work_path(t.spark, "stream-mirror")
    mirror.sync_changes(stream, "business_key", path, work_path(t.spark, "stream-mirror-checkpoint"))
    rows = mirror.read_mirror(t.spark, path, t.changes.schema, "business_key")
    return rows.select("business_key", "_pg_lsn", "status", "amount")


@query
def compacted_mirror(t):
    """The mirror's runs folded into one plain table."""
    changes = _change_files(t)
    stream = rollups.file_stream(t.spark, changes, t.changes.schema, files_per_trigger=4)
    path = work_path(t.spark, "stream-mirror")
    mirror.sync_changes(stream, "business_key", path, work_path(t.spark, "stream-mirror-checkpoint"))
    table = mirror.compact_mirror(t.spark, path, t.changes.schema, "business_key", work_path(t.spark, "mirror-table"))
    return table.select("business_key", "_pg_lsn", "status", "amount")


def _change_files(t):
    """The changes as a landing folder of several files, each row twice, as a feed that repeats deliveries."""
    path = work_path(t.spark, "changes")
    t.changes.unionByName(t.changes).repartition(8, "_pg_lsn").write.parquet(path)
    return path


@query
def stream_change_history(t):
    stream = mirror.as_ltz(rollups.file_stream(t.spark, _change_files(t), t.changes.schema, files_per_trigger=4), "_timestamp")
    path = work_path(t.spark, "stream-history")
    slice_by = F.floor(F.col("_pg_lsn") / (10**12 * 30))
    mirror.stream_cdc_history(stream, path, work_path(t.spark, "stream-history-checkpoint"), "business_key", slice_by)
    history = mirror.read_history(t.spark, path, stream.schema, "business_key")
    return history.select("business_key", "_pg_lsn", "_pg_change_type", "status", "amount", "valid_from", "valid_to", "is_current")


@query
def stream_decision_states(t):
    requests = Tables(t.spark, t.folder)
    requests.raw = lambda name: _event_stream(t)
    path = work_path(t.spark, "stream-decisions")
    stateful.stream_decisions(requests.decision_events, path, work_path(t.spark, "stream-decisions-checkpoint"))
    return log.read_log(t.spark, path, stateful.DECISION_OUTPUT).drop("batch")


@query
def stream_budget_alerts(t):
    base = usage.usage_base(t.usage_rows(_event_stream(t)), GATEWAYS)
    limits = {"alert": ALERT_USD, "block": HARD_STOP_USD}
    path = work_path(t.spark, "stream-budget")
    stateful.stream_budget_alerts(mirror.as_ltz(base, "event_time"), limits, path, work_path(t.spark, "stream-budget-checkpoint"))
    out = log.read_log(t.spark, path, stateful.BUDGET_OUTPUT)
    return out.select("requester", "limit_name", "request_id", "event_time", (F.col("running_units") / stateful.COST_UNITS).alias("running_cost_usd"))


# -- checks ------------------------------------------------------------------------------------------------------


@query
def quality_checks(t):
    return quality.all_checks(
        {
            "positions": quality.run_checks(
                t.position,
                [
                    quality.hero(SEGMENT, "HOUSEHOLD", "ios"), quality.cluster(["android", "web"]), quality.confined("ios"),
                    quality.exposure(30_000_000.0, 0.2, 0.1), quality.signal(), quality.domains(),
                ],
            ),
            "hero_match": quality.check_hero_match(t.open_rows, SEGMENT),
            "dedup": quality.check_note_dedup(t.snapshots),
            "learnable": quality.check_learnable(t.outcomes),
            "ramp": quality.check_ramp(t.conv, t.position, "2024-01-15"),
            "mix": quality.check_action_mix(t.recs),
            "reconcile": quality.check_reconcile(t.position),
            "rows": quality.check_row_counts("recommendation_rows", t.recs, t.open_rows),
            "keys": quality.check_keys(t.position, "segment_id"),
            "orphans": quality.check_orphans(t.decisions, t.position, "segment_id"),
        }
    )


@query
def message_positions(t):
    numbered = row_position(t.messages, ["conversation_id"], ["position"], F.floor(F.col("position") / 2), "n")
    return numbered.select("id", "n")

