"""Registered queries for upload contracts and table views (IO2-IO5, P3, P8,
S2, S3) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import display, panel
from tessera.plans.panel_queries import in_cents, MONTHLY_SQL, monthly
from tessera.sources import contracts, views
from tessera.sources.tables import read_table
from tessera.sources.views_sql import with_views

R = 6
STORE_SELECTION = {"store": "EUROPE", "product": "All Products"}
SORT_MAPPING = {"Month": "date", "Store": "store", "Product": "product", "Units": "sales_qty"}


def q_review_contract_labels(spark, sf_dir):
    """A raw documents table through the review upload contract: ``text`` is
    aliased to review_text, missing columns get defaults, and the label
    comes from the defaulted rating."""
    docs = contracts.review_contract(read_table(spark, sf_dir, "documents"))
    cols = T.derive_sentiment(F.col("rating"), None)
    return docs.select("doc_id", "category", "rating", "helpful_votes",
                       F.length("review_text").alias("text_chars"),
                       cols["sentiment"].alias("sentiment"),
                       (F.round(cols["confidence"], R) + F.lit(0.0)).alias("confidence"))


def q_sales_contract_rollup(spark, sf_dir):
    """A minimal sales upload (date, product, quantity) completed by the
    contract's defaults, then rolled up monthly."""
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    upload = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_shipdate").cast("date").alias("Date"), F.col("p_type").alias("Product"),
        F.col("l_quantity").cast("int").alias("Sales_Qty"))
    m = panel.monthly_rollup(in_cents(contracts.sales_contract(upload)))
    return m.withColumn("avg_price", F.round(F.col("avg_price") / 100.0, R) + F.lit(0.0))


def q_filtered_store_rollup(spark, sf_dir):
    """P3 on the interactive path: selections filter the sales rows before
    the rollup (the predicate reaches the region scan), and, as in that
    path, no imputation runs."""
    s = display.filter_equals(views.sales(spark, sf_dir), STORE_SELECTION)
    out = panel.monthly_rollup(in_cents(s))
    return out.withColumn("avg_price", F.round(F.col("avg_price") / 100.0, R) + F.lit(0.0))


def q_sales_display_page(spark, sf_dir):
    shown = display.sales_display(monthly(spark, sf_dir))
    ordered = display.sort_by(shown, "Units", SORT_MAPPING, ["date", "store", "product"])
    return display.first_page(ordered, display.PAGE_ROWS).select("month", "store", "product", "units", "promo")


QUERIES = {
    "review_contract_labels": q_review_contract_labels,
    "sales_contract_rollup": q_sales_contract_rollup,
    "filtered_store_rollup": q_filtered_store_rollup,
    "sales_display_page": q_sales_display_page,
}

_UPLOAD = """
SELECT CAST(l_shipdate AS DATE) AS date, p_type AS product, CAST(l_quantity AS INT) AS sales_qty,
       'Store_Default' AS store, 0 AS promotion, 100.0E0 AS price
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

ORACLES = {
    "review_contract_labels": f"""
SELECT doc_id, 'General' AS category, 3 AS rating, 0 AS helpful_votes, CAST(length(text) AS INTEGER) AS text_chars,
       'Neutral' AS sentiment, round(0.55E0, {R}) + 0.0E0 AS confidence FROM documents""",
    "sales_contract_rollup": with_views(
        f"SELECT date, store, product, sales_qty, promotion, round(avg_price, {R}) + 0.0E0 AS avg_price FROM monthly",
        extra={"sales": _UPLOAD, "monthly": MONTHLY_SQL}),
    "filtered_store_rollup": with_views(f"""
SELECT CAST(date_trunc('month', date) AS DATE) AS date, store, product,
       CAST(coalesce(sum(sales_qty), 0) AS BIGINT) AS sales_qty, max(promotion) AS promotion,
       round(avg(CAST(round(price*100) AS BIGINT)) / 100.0E0, {R}) + 0.0E0 AS avg_price
FROM sales WHERE store = 'EUROPE' AND date IS NOT NULL AND product IS NOT NULL
GROUP BY 1, 2, 3""", "sales"),
    "sales_display_page": with_views("""
SELECT strftime(date, '%Y-%m') AS month, store, product, format('{:,}', sales_qty) AS units,
       CASE WHEN promotion = 1 THEN '✓' ELSE '—' END AS promo
FROM monthly ORDER BY sales_qty, date, store, product LIMIT 500""", "sales", extra={"monthly": MONTHLY_SQL}),
}
