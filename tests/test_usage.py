import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from slidewatch.operators import usage

T0 = datetime.datetime(2024, 1, 1)
GATEWAYS = {"svc.a": "A", "svc.b": "B"}
USAGE = (
    "event_time timestamp_ntz, service_name string, endpoint_name string, destination_model string, destination_name string, "
    "request_tags map<string,string>, endpoint_tags map<string,string>, status_code int, requester string, request_id bigint, "
    "input_tokens bigint, output_tokens bigint, total_tokens bigint"
)


def request(i, service="svc.a", endpoint=None, tags=None, endpoint_tags=None, model=None, name=None, tokens=(0, 0, None), who="u", status=200, minutes=None):
    return (T0 + datetime.timedelta(minutes=i if minutes is None else minutes), service, endpoint, model, name, tags, endpoint_tags, status, who, i, *tokens)


def base(spark, rows):
    return usage.usage_base(spark.createDataFrame(rows, USAGE), GATEWAYS)


def test_missing_values_are_filled(spark):
    rows = [
        request(1, model="m", name="n", tags={"application": "app"}, tokens=(10, 5, 99)),
        request(2, service=None, endpoint="svc.b", name="n", endpoint_tags={"application": "e"}, tokens=(None, 5, None)),
        request(3, tags={"other": "x"}, tokens=(None, None, None)),
        request(4, service="svc.other"),
        request(5, service=None, endpoint=None),
    ]
    got = {r["request_id"]: r for r in base(spark, rows).collect()}
    assert set(got) == {1, 2, 3}
    assert [got[1][c] for c in ("gateway", "model", "application", "total_tokens")] == ["A", "m", "app", 99]
    assert [got[2][c] for c in ("gateway", "model", "application", "total_tokens", "input_tokens")] == ["B", "n", "e", 5, 0]
    assert [got[3][c] for c in ("model", "application", "total_tokens")] == ["(no destination)", "unattributed", 0]
    assert got[1]["est_cost_usd"] == Decimal("0.0000045000")


def test_spend_is_null_and_not_zero_when_absent(spark):
    spend = spark.createDataFrame([(Decimal("1.5"), ("svc.a",))], "usage_quantity decimal(18,6), usage_metadata struct<endpoint_name:string>")
    rows = base(spark, [request(1, tokens=(1000000, 0, None)), request(2, status=403)])
    row = usage.usage_summary(rows, spend, ["svc.a"]).first()
    assert (row["est_cost_usd"], row["requests"], row["blocked_403"], row["external_model_spend_usd"]) == (0.15, 2, 1, 1.5)
    assert usage.usage_summary(rows, spend, ["svc.b"]).first()["external_model_spend_usd"] is None


def test_budget_limits_are_reached_exactly(spark):
    rows = [request(i, tokens=(0, 10000, None), who="u") for i in range(1, 10)]  # 0.006 each: 0.03 after five
    rows += [request(50, tokens=(0, 1, None), who="v")]
    got = {r["requester"]: r for r in usage.budget_state(base(spark, rows)).collect()}
    assert got["u"]["state"] == "blocked" and got["u"]["alert_request_id"] == 5 and got["u"]["blocked_request_id"] == 9
    assert got["u"]["total_cost_usd"] == 0.054
    assert got["v"]["state"] == "ok" and got["v"]["alert_at"] is None


@pytest.mark.parametrize(
    ("text", "kind", "verdict"),
    [
        ("Give me ALL-warehouse data now", "request", "DENY"),
        ("run an unlimited query", "request", "DENY"),
        ("unlimited queries please", "request", "DENY"),
        ("a Full Database-Scan", "request", "DENY"),
        ("read every table", "response", "ALLOW"),
        ("Read one row of segment positions by key, limit 1", "request", "ALLOW"),
        (None, "request", "ALLOW"),
    ],
)
def test_policy(spark, text, kind, verdict):
    df = spark.createDataFrame([(text, kind)], "message string, type string")
    row = usage.evaluate_policy(df).first()
    assert row["result"] == verdict and bool(row["policy_reason"]) == (verdict == "DENY")
    usage.create_policy_function(spark, "policy_under_test")
    event = F.to_variant_object(F.struct("type", F.struct("message").alias("context")))
    same = df.select(event.alias("e")).select(F.expr("variant_get(policy_under_test(e), '$.result', 'string')").alias("r")).first()
    assert same["r"] == verdict


def test_marker_is_found_in_request_or_response_within_the_hour(spark):
    schema = "event_time timestamp_ntz, request_id string, status_code int, latency_ms bigint, requester string, request string, response string"
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    rows = [
        (at(0), "old", 200, 1, "u", "MARK", ""), (at(90), "mine", 200, 1, "u", "x", "say MARK"),
        (at(80), "earlier", 200, 1, "u", "MARK", "MARK"), (at(95), "none", 200, 1, "u", "x", None), (at(130), "later", 200, 1, "u", "MARK", ""),
    ]
    df = spark.createDataFrame(rows, schema)
    got = usage.find_marker(df, "MARK", "2024-01-01 02:00:00").collect()
    assert [(r["request_id"], r["marker_in_request"], r["marker_in_response"]) for r in got] == [("mine", False, True)]


def test_hourly_costs_add_up_to_the_summary(tables):
    hourly = usage.usage_hourly(tables.usage_base).agg(F.sum("requests").alias("n"), F.sum("total_tokens").alias("t")).first()
    summary = usage.usage_summary(tables.usage_base, tables.spend, ["svc.app_gateway"]).first()
    assert (hourly["n"], hourly["t"]) == (summary["requests"], summary["total_tokens"])
