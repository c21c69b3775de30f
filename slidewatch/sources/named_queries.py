"""A closed list of named SQL queries with bound table locations and parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

NAMED_QUERIES: Mapping[str, str] = {
    "daily_refund_trend": """
        SELECT return_date, CAST(round(sum(refund_amount_usd), 2) AS DOUBLE) AS total_refund_usd
        FROM IDENTIFIER(:prefix || 'silver_returns')
        WHERE return_date BETWEEN date_sub(CAST(:as_of AS DATE), 30) AND CAST(:as_of AS DATE)
        GROUP BY return_date
        ORDER BY return_date
    """,
    "returns_by_product": """
        SELECT product_name, count(*) AS return_count,
               CAST(round(sum(refund_amount_usd), 2) AS DOUBLE) AS total_refund_usd
        FROM IDENTIFIER(:prefix || 'silver_returns')
        GROUP BY product_name
        ORDER BY return_count DESC, product_name
        LIMIT 10
    """,
    "worst_lots": """
        WITH sold AS (
          SELECT lot_id, sum(quantity) AS units, mode(region, true) AS region
          FROM IDENTIFIER(:prefix || 'silver_order_items') GROUP BY lot_id
        ), back AS (
          SELECT lot_id, count(*) AS return_count, sum(refund_amount_usd) AS refund
          FROM IDENTIFIER(:prefix || 'silver_returns') GROUP BY lot_id
        )
        SELECT lot_id, product_name, facility, sold.region, return_count,
               CAST(coalesce(units, 0) AS BIGINT) AS units_sold,
               CASE WHEN units > 0 THEN round(CAST(return_count AS DOUBLE) * 100D / units, 1) ELSE 0D END AS return_rate_pct,
               CAST(round(refund, 2) AS DOUBLE) AS total_refund_usd
        FROM IDENTIFIER(:prefix || 'raw_production_lots')
        JOIN IDENTIFIER(:prefix || 'raw_products') USING (product_id)
        JOIN back USING (lot_id)
        LEFT JOIN sold USING (lot_id)
        ORDER BY return_rate_pct DESC, lot_id
        LIMIT 20
    """,
}


def run_query(
    spark: SparkSession, key: str, catalog: str | None = None, schema: str | None = None, **params: object
) -> DataFrame:
    """Runs one of the named queries. Tables are ``catalog.schema.table``; without them, views of the session."""
    if key not in NAMED_QUERIES:
        raise KeyError(f"unknown query: {key}")
    text = NAMED_QUERIES[key]
    prefix = "".join(f"{part}." for part in (catalog, schema) if part)
    used = {name: value for name, value in params.items() if f":{name}" in text}
    return spark.sql(text, args={"prefix": prefix, **used})
