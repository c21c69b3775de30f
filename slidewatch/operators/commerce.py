"""Returns, lots, facilities and customers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidewatch.functions.exprs import count_if, percentage

RETURN_SORTS = {"anger": "anger_score", "recent": "return_date", "value": "refund_amount_usd"}


def _refund() -> Column:
    return F.round(F.sum("refund_amount_usd"), 2).cast("double")


def _n() -> Column:
    return F.count(F.lit(1))


def daily_refund_trend(returns: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Refunds per day of the ``days`` days up to and including ``as_of``; later rows are not part of it."""
    last = F.lit(as_of).cast("date")
    recent = returns.where(F.col("return_date").between(F.date_sub(last, days), last))
    return recent.groupBy("return_date").agg(_refund().alias("total_refund_usd")).orderBy("return_date")


def returns_by_product(returns: DataFrame, n: int = 10) -> DataFrame:
    totals = returns.groupBy("product_name").agg(_n().alias("return_count"), _refund().alias("total_refund_usd"))
    return totals.orderBy(F.col("return_count").desc(), "product_name").limit(n)


def worst_lots(lots: DataFrame, products: DataFrame, items: DataFrame, returns: DataFrame, n: int = 20) -> DataFrame:
    """Lots with at least one return by return rate. Items and returns are added up per lot before any join.

    One sum per lot and region gives both the units and the most frequent region.
    """
    regional = items.groupBy("lot_id", "region").agg(F.sum("quantity").alias("_units"), _n().alias("_lines"))
    most = F.min(F.struct((-F.col("_lines")).alias("n"), F.col("region").alias("v"))).alias("_most")
    sold = regional.groupBy("lot_id").agg(F.sum("_units").alias("_units"), most)
    sold = sold.select("lot_id", "_units", F.col("_most.v").alias("region"))
    back = returns.groupBy("lot_id").agg(_n().alias("return_count"), F.sum("refund_amount_usd").alias("_refund"))
    joined = (
        lots.join(products.select("product_id", "product_name"), "product_id")
        .join(back, "lot_id")  # lots without returns are left out
        .join(sold, "lot_id", "left")
    )
    return (
        joined.select(
            "lot_id", "product_name", "facility", "region", "return_count",
            F.coalesce("_units", F.lit(0)).cast("long").alias("units_sold"),
            percentage("return_count", "_units").alias("return_rate_pct"),
            F.round("_refund", 2).cast("double").alias("total_refund_usd"),
        )
        .orderBy(F.col("return_rate_pct").desc(), "lot_id")
        .limit(n)
    )


def returns_summary(returns: DataFrame) -> DataFrame:
    return returns.groupBy("status").agg(_n().alias("n"), _refund().alias("total_usd"))


def _filtered(returns: DataFrame, status: str | None, lot: int | None) -> DataFrame:
    if status is not None:
        returns = returns.where(F.col("status") == status)
    if lot is not None:
        returns = returns.where(F.col("lot_id") == lot)
    return returns


def with_tier(returns: DataFrame, tiers: DataFrame) -> DataFrame:
    """Predicted tier of the customer; customers without a prediction keep null tiers."""
    return returns.join(
        tiers.select("customer_id", "final_tier", "premium_status_labeled", "premium_prob"), "customer_id", "left"
    )


def _tier_is(tier: str) -> Column:
    return F.coalesce(F.col("final_tier") == tier, F.lit(False))


def _labelled() -> Column:
    return _tier_is("premium") & F.coalesce(F.col("premium_status_labeled") == "premium", F.lit(False))


def _hidden() -> Column:
    return _tier_is("premium") & F.coalesce(F.col("premium_status_labeled") != "premium", F.lit(True))


def _sum_if(condition: Column) -> Column:
    """Returns of the customers that meet a condition."""
    return F.coalesce(F.sum(F.when(condition, F.col("_returns"))), F.lit(0)).cast("long")


def city_breakdown(
    returns: DataFrame, customers: DataFrame, tiers: DataFrame, status: str | None = None, lot: int | None = None
) -> DataFrame:
    """Per city: mean coordinates, returns, distinct customers and premium returns. Null coordinates are left out.

    Returns are first added up per customer, so a customer with very many returns is one row in the joins, and
    distinct customers become a plain count.
    """
    per_customer = _filtered(returns, status, lot).groupBy("customer_id").agg(
        _n().alias("_returns"), F.sum("refund_amount_usd").alias("_refund")
    )
    located = customers.where(F.col("customer_lat").isNotNull() & F.col("customer_lng").isNotNull())
    joined = with_tier(per_customer.join(located, "customer_id"), tiers)
    return joined.groupBy("city", "country").agg(
        (F.sum(F.col("customer_lat") * F.col("_returns")) / F.sum("_returns")).alias("lat"),
        (F.sum(F.col("customer_lng") * F.col("_returns")) / F.sum("_returns")).alias("lng"),
        F.sum("_returns").alias("total"),
        F.count("customer_id").alias("customers"),
        F.coalesce(F.sum(F.when(_tier_is("premium"), F.col("_returns"))), F.lit(0)).cast("long").alias("premium"),
        F.round(F.sum("_refund"), 2).cast("double").alias("refund_usd"),
    )


def facility_summary(returns: DataFrame) -> DataFrame:
    return returns.groupBy("facility").agg(
        _n().alias("return_count"),
        count_if(F.col("status") == "pending").alias("pending_count"),
        _refund().alias("total_refund_usd"),
    )


def facility_lots(returns: DataFrame, facility: str | None = None, n: int | None = 5) -> DataFrame:
    """Lots within a facility with their product names. With no facility, the top lots of every facility.

    Names are made distinct by grouping before they are gathered; a lot has few distinct names.
    """
    if facility is not None:
        returns = returns.where(F.col("facility") == facility)
    per_product = returns.groupBy("facility", "lot_id", "product_name").agg(
        _n().alias("_returns"),
        count_if(F.col("status") == "pending").alias("_pending"),
        F.sum("refund_amount_usd").alias("_refund"),
    )
    lots = per_product.groupBy("facility", "lot_id").agg(
        F.sum("_returns").alias("return_count"),
        F.sum("_pending").alias("pending_count"),
        F.round(F.sum("_refund"), 2).cast("double").alias("total_refund_usd"),
        F.count("product_name").alias("product_count"),
        F.array_join(F.array_sort(F.collect_list("product_name")), ", ").alias("product_names"),
    )
    if n is None:
        return lots
    if facility is not None:
        return lots.orderBy(F.col("return_count").desc(), "lot_id").limit(n)
    by_count = Window.partitionBy("facility").orderBy(F.col("return_count").desc(), F.col("lot_id").asc())
    # Spark keeps only the first n rows of each facility per task before it shuffles for this window.
    return lots.withColumn("rn", F.row_number().over(by_count)).where(F.col("rn") <= n).drop("rn")


def customer_orders(orders: DataFrame, items: DataFrame, customer_id: int | None = None, n: int = 10) -> DataFrame:
    """Latest orders with item count, of one customer or of every customer."""
    if customer_id is not None:
        orders = orders.where(F.col("customer_id") == customer_id)
        newest = orders.orderBy(F.col("order_date").desc(), F.col("order_id").desc()).limit(n)
    else:
        by_date = Window.partitionBy("customer_id").orderBy(F.col("order_date").desc(), F.col("order_id").desc())
        newest = orders.withColumn("rn", F.row_number().over(by_date)).where(F.col("rn") <= n).drop("rn")
    if customer_id is not None:  # a handful of orders: only their items are counted
        items = items.join(F.broadcast(newest.select("order_id")), "order_id", "left_semi")
    counts = items.groupBy("order_id").agg(_n().alias("_items"))
    return newest.join(counts, "order_id", "left").select(
        "customer_id", "order_id", "order_date", "total_usd", "status",
        F.coalesce("_items", F.lit(0).cast("long")).alias("item_count"),
    )


def list_returns(
    returns: DataFrame,
    tiers: DataFrame,
    customers: DataFrame | None = None,
    status: str | None = None,
    lot: int | None = None,
    tier: str | None = None,
    country: str | None = None,
    sort: str = "recent",
    n: int | None = 100,
) -> DataFrame:
    """Return queue with tier and score; every filter is optional."""
    rows = with_tier(_filtered(returns, status, lot), tiers)
    if tier is not None:
        rows = rows.where(F.col("final_tier") == tier)
    if country is not None:
        rows = rows.join(customers.where(F.col("country") == country).select("customer_id"), "customer_id", "left_semi")
    rows = rows.orderBy(F.col(RETURN_SORTS[sort]).desc_nulls_last(), "return_id")
    return rows if n is None else rows.limit(n)


def lot_summary(returns: DataFrame, n: int = 10) -> DataFrame:
    lots = returns.groupBy("lot_id").agg(
        _n().alias("return_count"), count_if(F.col("status") == "pending").alias("pending_count"),
        _refund().alias("total_refund_usd"),
    )
    return lots.orderBy(F.col("return_count").desc(), "lot_id").limit(n)


def country_breakdown(
    returns: DataFrame, customers: DataFrame, tiers: DataFrame, status: str | None = None, lot: int | None = None
) -> DataFrame:
    """Returns per country and tier. They are added up per customer first, so each customer is one row in the joins."""
    per_customer = _filtered(returns, status, lot).groupBy("customer_id").agg(
        _n().alias("_returns"), F.sum("refund_amount_usd").alias("_refund")
    )
    rows = with_tier(per_customer.join(customers.select("customer_id", "country"), "customer_id"), tiers)
    return rows.groupBy("country").agg(
        F.sum("_returns").alias("total"),
        _sum_if(_tier_is("premium")).alias("premium"),
        _sum_if(_labelled()).alias("premium_labeled"),
        _sum_if(_hidden()).alias("premium_hidden"),
        F.round(F.sum("_refund"), 2).cast("double").alias("refund_usd"),
    )


def tier_breakdown(
    returns: DataFrame, customers: DataFrame, tiers: DataFrame, lot: int | None = None, top_countries: int = 3
) -> DataFrame:
    """Tier split of the pending returns of one lot, or of every lot, with the most frequent countries."""
    pending = _filtered(returns, "pending", lot).groupBy("lot_id", "customer_id").agg(
        _n().alias("_returns"), F.sum("refund_amount_usd").alias("_refund")
    )
    rows = with_tier(pending.join(customers.select("customer_id", "country"), "customer_id"), tiers)
    refund = F.col("_refund")
    zero = F.lit(0).cast("decimal(18,4)")
    per_country = rows.groupBy("lot_id", "country").agg(
        F.sum("_returns").alias("total"),
        _sum_if(_tier_is("premium")).alias("premium_count"),
        _sum_if(_tier_is("standard")).alias("standard_count"),
        _sum_if(_labelled()).alias("premium_labeled_count"),
        _sum_if(_hidden()).alias("premium_predicted_hidden_count"),
        _sum_if(F.col("final_tier").isNull()).alias("no_prediction_count"),
        F.sum(F.when(_tier_is("premium"), refund).otherwise(zero)).alias("_premium_refund"),
        F.sum(F.when(_tier_is("premium"), zero).otherwise(refund)).alias("_standard_refund"),
    )
    sums = ["total", "premium_count", "standard_count", "premium_labeled_count", "premium_predicted_hidden_count", "no_prediction_count"]
    country = F.struct((-F.col("total")).alias("n"), F.col("country"))
    lots = per_country.groupBy("lot_id").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.round(F.sum("_premium_refund"), 2).cast("double").alias("premium_refund_usd"),
        F.round(F.sum("_standard_refund"), 2).cast("double").alias("standard_refund_usd"),
        F.slice(F.array_sort(F.collect_list(country)), 1, top_countries).alias("_top"),  # one entry per country
    )
    return lots.withColumn("top_countries", F.array_join(F.transform("_top", lambda c: c["country"]), ", ")).drop("_top")


def apply_tier_offers(
    returns: DataFrame, tiers: DataFrame, lot: int | None, offers: Mapping[str, int], at: str, by: str
) -> DataFrame:
    """Pending returns of the lot get the coupon of their tier, become approved and gain a trail entry.

    Returns without a predicted tier get the standard offer. Other rows are unchanged. ``applied_tier`` tells
    which offer a row received.
    """
    rows = with_tier(returns, tiers)
    chosen = F.col("status") == "pending"
    if lot is not None:
        chosen = chosen & (F.col("lot_id") == lot)
    tier = F.when(_tier_is("premium"), F.lit("premium")).otherwise(F.lit("standard"))
    percent = F.when(tier == "premium", F.lit(offers["premium"])).otherwise(F.lit(offers["standard"]))
    note = (
        F.when(_labelled(), F.lit("premium (labelled)")).when(_hidden(), F.lit("premium (predicted)")).otherwise(F.lit("standard"))
    )
    entry = F.struct(
        F.lit(at).cast("timestamp_ntz").alias("at"), F.lit(by).alias("by"), F.lit("approved").alias("action"),
        note.alias("notes"),
    )
    return rows.withColumns(
        {
            "coupon_pct_applied": F.when(chosen, percent).otherwise(F.col("coupon_pct_applied")),
            "audit_trail": F.when(chosen, F.array_append("audit_trail", entry)).otherwise(F.col("audit_trail")),
            "status": F.when(chosen, F.lit("approved")).otherwise(F.col("status")),
            "applied_tier": F.when(chosen, tier),
            "label_note": F.when(chosen, note),
        }
    )


def offer_summary(applied: DataFrame) -> DataFrame:
    got = F.col("applied_tier")
    return applied.agg(
        count_if(got == "premium").alias("premium_email_count"),
        count_if(F.col("label_note") == "premium (labelled)").alias("premium_labeled_count"),
        count_if(F.col("label_note") == "premium (predicted)").alias("premium_predicted_hidden_count"),
        count_if(got == "standard").alias("standard_email_count"),
        count_if(got.isNotNull()).alias("approved_count"),
        F.round(F.sum(F.when(got.isNotNull(), F.col("refund_amount_usd"))), 2).cast("double").alias("total_refund_usd"),
    )


def skipped_returns(attempted: DataFrame, applied: DataFrame) -> DataFrame:
    """Ids that were asked for but not changed."""
    done = applied.where(F.col("applied_tier").isNotNull()).select("return_id")
    return attempted.select("return_id").join(done, "return_id", "left_anti")


def decide_returns(returns: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applies (return_id, decision, at, by, notes) rows: new status and one more trail entry."""
    made = decisions.select(
        "return_id", F.col("decision").alias("_decision"),
        F.struct("at", "by", F.col("decision").alias("action"), "notes").alias("_entry"),
    )
    rows = returns.join(made, "return_id", "left")
    hit = F.col("_decision").isNotNull()
    return rows.withColumns(
        {
            "status": F.when(hit, F.col("_decision")).otherwise(F.col("status")),
            "audit_trail": F.when(hit, F.array_append("audit_trail", F.col("_entry"))).otherwise(F.col("audit_trail")),
            "decided_at": F.when(hit, F.col("_entry.at")).otherwise(F.col("decided_at")),
        }
    ).drop("_decision", "_entry")
