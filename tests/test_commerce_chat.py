import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from slidewatch.operators import chat, commerce

RETURNS = (
    "return_id string, customer_id bigint, lot_id bigint, product_name string, facility string, status string, "
    "refund_amount_usd decimal(18,4), return_date date, anger_score double, coupon_pct_applied int, "
    "audit_trail array<struct<at:timestamp_ntz,by:string,action:string,notes:string>>, decided_at timestamp_ntz"
)
DAY = datetime.date(2024, 1, 10)


def ret(i, customer=1, lot=7, product="ring", facility="F", status="pending", usd="10.0050", day=DAY, anger=0.5):
    return (i, customer, lot, product, facility, status, Decimal(usd), day, anger, None, [], None)


@pytest.fixture(scope="module")
def returns(spark):
    rows = [ret("r1"), ret("r2", customer=2, usd="5.0000"), ret("r3", customer=3, status="rejected"), ret("r4", customer=4, lot=8, product="rod"), ret("r5", customer=2, product="cap", anger=None)]
    return spark.createDataFrame(rows, RETURNS)


@pytest.fixture(scope="module")
def tiers(spark):
    rows = [(1, 0.9, "premium", None), (2, 0.8, "premium", "premium"), (3, 0.1, "standard", "not_premium")]
    return spark.createDataFrame(rows, "customer_id bigint, premium_prob double, final_tier string, premium_status_labeled string")


@pytest.fixture(scope="module")
def customers(spark):
    rows = [(1, "A", "x", 1.0, 2.0), (2, "A", "x", 3.0, 4.0), (3, "B", "y", None, 1.0), (4, "B", "y", 5.0, 5.0)]
    return spark.createDataFrame(rows, "customer_id bigint, country string, city string, customer_lat double, customer_lng double")


def test_tier_offers(spark, returns, tiers):
    applied = commerce.apply_tier_offers(returns, tiers, 7, {"premium": 30, "standard": 10}, "2024-02-01 00:00:00", "agent")
    got = {r["return_id"]: r for r in applied.collect()}
    assert [got[i]["coupon_pct_applied"] for i in ("r1", "r2", "r3", "r4", "r5")] == [30, 30, None, None, 30]
    assert got["r1"]["status"] == "approved" and got["r1"]["audit_trail"][0]["notes"] == "premium (predicted)"
    assert got["r2"]["audit_trail"][0]["notes"] == "premium (labelled)"
    assert got["r3"]["status"] == "rejected" and got["r3"]["audit_trail"] == []
    summary = commerce.offer_summary(applied).first()
    assert (summary["approved_count"], summary["premium_labeled_count"], summary["premium_predicted_hidden_count"], summary["standard_email_count"]) == (3, 2, 1, 0)
    assert [r["return_id"] for r in commerce.skipped_returns(returns.where("lot_id = 7"), applied).collect()] == ["r3"]
    unscored = commerce.apply_tier_offers(returns, tiers, 8, {"premium": 30, "standard": 10}, "2024-02-01 00:00:00", "agent")
    assert unscored.where("return_id = 'r4'").first()["coupon_pct_applied"] == 10


def test_city_skips_null_coordinates_and_weighs_by_return(returns, customers, tiers):
    rows = {r["city"]: r for r in commerce.city_breakdown(returns, customers, tiers).collect()}
    assert rows["x"]["total"] == 3 and rows["x"]["customers"] == 2 and rows["x"]["premium"] == 3
    assert rows["x"]["lat"] == pytest.approx(7 / 3)
    assert rows["y"]["total"] == 1 and rows["y"]["premium"] == 0


def test_tier_breakdown_and_countries(returns, customers, tiers):
    row = commerce.tier_breakdown(returns, customers, tiers, lot=7).first()
    assert (row["total"], row["premium_count"], row["no_prediction_count"], row["top_countries"]) == (3, 3, 0, "A")
    rows = {r["country"]: r for r in commerce.country_breakdown(returns, customers, tiers).collect()}
    assert (rows["A"]["premium_labeled"], rows["A"]["premium_hidden"], rows["B"]["total"]) == (2, 1, 2)


def test_return_queue_filters_and_sorts(returns, customers, tiers):
    ids = lambda **kw: [r["return_id"] for r in commerce.list_returns(returns, tiers, customers, **kw).collect()]
    assert ids(status="pending", lot=7, sort="anger") == ["r1", "r2", "r5"]  # nulls last
    assert ids(sort="value", n=2) == ["r1", "r3"]
    assert ids(tier="standard") == ["r3"]
    assert ids(country="B") == ["r3", "r4"]


def test_facility_lots_join_distinct_names(returns):
    row = commerce.facility_lots(returns, "F", 1).first()
    assert (row["lot_id"], row["return_count"], row["pending_count"], row["product_count"], row["product_names"]) == (7, 4, 3, 2, "cap, ring")
    assert row["total_refund_usd"] == 35.02  # 35.0150, halves go up


def test_worst_lots_without_sales_have_rate_zero(spark, returns):
    lots = spark.createDataFrame([(7, 1, "F"), (8, 1, "F"), (9, 1, "F")], "lot_id bigint, product_id bigint, facility string")
    products = spark.createDataFrame([(1, "ring")], "product_id bigint, product_name string")
    items = spark.createDataFrame([(7, 40, "N"), (7, 10, "N"), (7, 10, "M")], "lot_id bigint, quantity bigint, region string")
    rows = commerce.worst_lots(lots, products, items, returns).collect()
    assert [(r["lot_id"], r["units_sold"], r["return_rate_pct"], r["region"]) for r in rows] == [(7, 60, 6.7, "N"), (8, 0, 0.0, None)]


def test_decided_returns(spark, returns):
    made = spark.createDataFrame([("r1", "rejected", datetime.datetime(2024, 2, 1), "bo", "late")], "return_id string, decision string, at timestamp_ntz, by string, notes string")
    got = {r["return_id"]: r for r in commerce.decide_returns(returns, made).collect()}
    assert got["r1"]["status"] == "rejected" and got["r1"]["audit_trail"][0]["by"] == "bo" and got["r1"]["decided_at"] is not None
    assert got["r2"]["status"] == "pending" and got["r2"]["decided_at"] is None


def test_refund_trend_and_orders(spark, returns):
    old = returns.withColumn("return_date", F.date_sub("return_date", 31))
    assert commerce.daily_refund_trend(returns.unionByName(old), "2024-01-10").count() == 1
    orders = spark.createDataFrame([(i, 1, DAY, 1.0, "O") for i in range(15)], "order_id bigint, customer_id bigint, order_date date, total_usd double, status string")
    items = spark.createDataFrame([(14, 1)], "order_id bigint, lot_id bigint")
    rows = {r["order_id"]: r["item_count"] for r in commerce.customer_orders(orders, items, n=10).collect()}
    assert rows == {14: 1, **{i: 0 for i in range(5, 14)}}


def test_new_messages_follow_the_last_position(spark):
    messages = spark.createDataFrame([("a", 0), ("a", 4)], "conversation_id string, position bigint")
    incoming = spark.createDataFrame([("a", s, "user", "x") for s in range(7)] + [("new", 5, "user", "y")], "conversation_id string, sequence int, role string, content string")
    got = sorted((r["conversation_id"], r["position"]) for r in chat.append_messages(messages, incoming, block=3).collect())
    assert got == [("a", p) for p in range(5, 12)] + [("new", 0)]


def test_deleting_conversations_takes_messages_and_feedback(spark):
    conversations = spark.createDataFrame([("a",), ("b",)], "id string")
    messages = spark.createDataFrame([("m1", "a"), ("m2", "b")], "id string, conversation_id string")
    feedback = spark.createDataFrame([("f1", "m1", "up"), ("f2", "m2", "down"), ("f3", "m2", "up")], "id string, message_id string, value string")
    left = chat.delete_conversations(conversations, messages, feedback, conversations.where("id = 'b'"))
    assert [[r["id"] for r in df.collect()] for df in left] == [["a"], ["m1"], ["f1"]]
    votes = {r["conversation_id"]: (r["up"], r["down"]) for r in chat.feedback_rollup(feedback, messages).collect()}
    assert votes == {"a": (1, 0), "b": (1, 1)}


def test_conversations_newest_first(tables):
    mine = chat.conversation_list(tables.conversations, "user-1@example.com").collect()
    assert mine and [r["updated_at"] for r in mine] == sorted((r["updated_at"] for r in mine), reverse=True)
    talk = chat.transcript(tables.conversations, tables.messages, mine[0]["id"]).collect()
    assert [r["position"] for r in talk] == list(range(len(talk)))
