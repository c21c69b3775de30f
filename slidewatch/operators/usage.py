"""AI usage, cost, budget and request policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidewatch.functions.exprs import count_if
from slidewatch.functions.scan import running_total
from slidewatch.operators.joins import attach_scalar
from slidewatch.settings import (
    ALERT_USD,
    HARD_STOP_USD,
    TokenPrices,
    unbounded_read_phrases,
    unbounded_read_reason,
)

COST_TYPE = "decimal(28,10)"


def token_cost(input_tokens: Column, output_tokens: Column, prices: TokenPrices = TokenPrices()) -> Column:
    """Exact decimal cost, so that totals do not depend on the order in which rows are added."""
    per_token = [Decimal(p) / 1000000 for p in (prices.input_per_million, prices.output_per_million)]
    parts = [
        tokens.cast("decimal(18,0)") * F.lit(f"{price:.10f}").cast("decimal(12,10)")
        for tokens, price in zip((input_tokens, output_tokens), per_token, strict=True)
    ]
    return (parts[0] + parts[1]).cast(COST_TYPE)


def usage_base(usage: DataFrame, gateways: Mapping[str, str], prices: TokenPrices = TokenPrices()) -> DataFrame:
    """Requests of the named services, with missing model, application and token values filled in.

    ``gateways`` maps a service name to its display name; requests of other services are left out.
    """
    service = F.coalesce("service_name", "endpoint_name")
    names = F.create_map(*[F.lit(x) for pair in gateways.items() for x in pair])
    tokens_in = F.coalesce("input_tokens", F.lit(0)).cast("long")
    tokens_out = F.coalesce("output_tokens", F.lit(0)).cast("long")
    return usage.where(service.isin(list(gateways))).select(
        "event_time",
        F.element_at(names, service).alias("gateway"),
        F.coalesce("destination_model", "destination_name", F.lit("(no destination)")).alias("model"),
        F.coalesce(
            F.col("request_tags")["application"], F.col("endpoint_tags")["application"], F.lit("unattributed")
        ).alias("application"),
        "status_code", "requester", "request_id",
        tokens_in.alias("input_tokens"),
        tokens_out.alias("output_tokens"),
        F.coalesce("total_tokens", tokens_in + tokens_out).alias("total_tokens"),
        token_cost(tokens_in, tokens_out, prices).alias("est_cost_usd"),
        F.col("request_tags")["decision_id"].alias("decision_id"),
    )


def _cost_sum() -> Column:
    return F.round(F.sum("est_cost_usd"), 6).cast("double").alias("est_cost_usd")


def external_spend(spend: DataFrame, gateways: Sequence[str]) -> DataFrame:
    """One row; null, not 0, when no spend is recorded for the services."""
    scoped = spend.where(F.col("usage_metadata.endpoint_name").isin(list(gateways)))
    return scoped.agg(F.round(F.sum("usage_quantity"), 6).cast("double").alias("external_model_spend_usd"))


def usage_summary(
    base: DataFrame, spend: DataFrame, gateways: Sequence[str], alert: float = ALERT_USD, hard_stop: float = HARD_STOP_USD
) -> DataFrame:
    summary = base.agg(
        _cost_sum(),
        F.count(F.lit(1)).alias("requests"),
        F.sum("total_tokens").alias("total_tokens"),
        count_if(F.col("status_code") == 403).alias("blocked_403"),
    ).select("*", F.lit(float(alert)).alias("alert_usd"), F.lit(float(hard_stop)).alias("hard_stop_usd"))
    return attach_scalar(summary, external_spend(spend, gateways))


def _usage_totals(base: DataFrame, *keys: Column | str) -> DataFrame:
    return base.groupBy(*keys).agg(
        _cost_sum(), F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("requests")
    )


def usage_hourly(base: DataFrame) -> DataFrame:
    return _usage_totals(base, F.date_trunc("hour", "event_time").alias("hour"), "gateway")


def usage_by_model(base: DataFrame) -> DataFrame:
    return _usage_totals(base, "gateway", "model").orderBy(F.col("est_cost_usd").desc_nulls_last(), "gateway", "model")


def request_log(base: DataFrame, n: int = 100) -> DataFrame:
    newest = base.orderBy(F.col("event_time").desc(), F.col("request_id").desc()).limit(n)
    return newest.drop("decision_id").withColumn("est_cost_usd", F.round("est_cost_usd", 6).cast("double"))


def running_cost(base: DataFrame, slice_unit: str = "hour") -> DataFrame:
    rows = base.select("requester", "event_time", "request_id", "est_cost_usd")
    return running_total(
        rows, ["requester"], ["event_time", "request_id"], F.col("est_cost_usd"),
        F.date_trunc(slice_unit, "event_time"), "running_cost_usd",
    )


def budget_state(base: DataFrame, alert: float = ALERT_USD, hard_stop: float = HARD_STOP_USD) -> DataFrame:
    """Total cost per requester and the first request at which each limit was reached."""
    cost = F.col("running_cost_usd")
    moment = F.struct("event_time", "request_id")
    states = running_cost(base).groupBy("requester").agg(
        F.sum("est_cost_usd").alias("_total"),
        F.min(F.when(cost >= F.lit(str(alert)).cast(COST_TYPE), moment)).alias("_alert"),
        F.min(F.when(cost >= F.lit(str(hard_stop)).cast(COST_TYPE), moment)).alias("_stop"),
    )
    state = F.when(F.col("_stop").isNotNull(), F.lit("blocked")).when(F.col("_alert").isNotNull(), F.lit("alert")).otherwise(F.lit("ok"))
    return states.select(
        "requester", F.round("_total", 8).cast("double").alias("total_cost_usd"), state.alias("state"),
        F.col("_alert.event_time").alias("alert_at"), F.col("_alert.request_id").alias("alert_request_id"),
        F.col("_stop.event_time").alias("blocked_at"), F.col("_stop.request_id").alias("blocked_request_id"),
    )


def normalised(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("-"), F.lit(" "))


def evaluate_policy(requests: DataFrame, text: str = "message", kind: str = "type", store: str = "warehouse") -> DataFrame:
    """Adds ``result`` and ``policy_reason``: a request whose text contains a listed phrase is denied."""
    hit: Column = F.lit(False)
    for phrase in unbounded_read_phrases(store):
        hit = hit | normalised(F.col(text)).contains(phrase)
    denied = F.coalesce((F.col(kind) == "request") & hit, F.lit(False))
    return requests.withColumns(
        {
            "result": F.when(denied, F.lit("DENY")).otherwise(F.lit("ALLOW")),
            "policy_reason": F.when(denied, F.lit(unbounded_read_reason(store))).otherwise(F.lit("")),
        }
    )


def create_policy_function(spark: SparkSession, name: str = "block_unbounded_read", store: str = "warehouse") -> None:
    """The same policy as a SQL function from a VARIANT event to a VARIANT verdict."""
    message = "replace(lower(variant_get(event, '$.context.message', 'string')), '-', ' ')"
    hits = " OR ".join(f"{message} LIKE '%{phrase}%'" for phrase in unbounded_read_phrases(store))
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(event VARIANT) RETURNS VARIANT
        RETURN CASE
          WHEN variant_get(event, '$.type', 'string') = 'request' AND ({hits})
          THEN to_variant_object(named_struct('result', 'DENY', 'reason', '{unbounded_read_reason(store)}'))
          ELSE to_variant_object(named_struct('result', 'ALLOW', 'reason', ''))
        END
        """
    )


def find_marker(payload: DataFrame, marker: str, as_of: str, hours: int = 1, n: int = 1) -> DataFrame:
    """Newest rows of the last hours whose request or response contains the marker."""
    now = F.lit(as_of).cast("timestamp_ntz")
    in_request = F.instr("request", marker) > 0
    in_response = F.instr("response", marker) > 0
    recent = payload.where(
        (F.col("event_time") >= now - F.expr(f"INTERVAL {int(hours)} HOUR")) & (F.col("event_time") <= now)
    )
    return (
        recent.where(in_request | in_response)
        .select(
            "event_time", "request_id", "status_code", "latency_ms",
            F.coalesce(in_request, F.lit(False)).alias("marker_in_request"),
            F.coalesce(in_response, F.lit(False)).alias("marker_in_response"), "requester",
        )
        .orderBy(F.col("event_time").desc(), "request_id")
        .limit(n)
    )


def cost_per_decision(base: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cost by tagged decision, with its segment and status. Costs are added per tag before the join."""
    per_tag = base.where(F.col("decision_id").isNotNull()).groupBy("decision_id").agg(
        F.sum("est_cost_usd").alias("_cost"), F.count(F.lit(1)).alias("requests")
    )
    return per_tag.join(decisions.select("decision_id", "segment_id", "status"), "decision_id").select(
        "decision_id", "segment_id", "status", "requests", F.round("_cost", 8).cast("double").alias("est_cost_usd")
    )


def latency_summary(payload: DataFrame) -> DataFrame:
    return payload.groupBy("api_type", "status_code").agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )
