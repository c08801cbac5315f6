"""Registered panel (sales) queries and their DuckDB oracles.

Float outputs are rounded to 6 digits on both sides so the engine-neutral
value hash compares the same numbers; money means use integer cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics, panel
from tessera.session import materialize
from tessera.sources import views
from tessera.sources.views_sql import with_views

R = 6  # digits kept for floating outputs in registered queries


def _round(df: DataFrame, cols) -> DataFrame:
    # "+ 0.0" turns a rounded -0.0 into 0.0 so both engines print the same value
    return df.withColumns({c: F.round(F.col(c), R) + F.lit(0.0) for c in cols})


def in_cents(sales: DataFrame) -> DataFrame:
    """Prices as whole cents, so that sums are exact in any order."""
    return sales.withColumn("price", F.round(F.col("price") * 100).cast("bigint"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales view -> median impute + monthly rollup in one pass over the
    joins.  The small grouping-sets aggregate is always checkpointed: the
    median (from its histogram rows) and the monthly groups both read it, so
    the scans and joins run exactly once.  The fixture's quantities are whole
    and never NULL, so their sums are longs."""
    rows = panel.imputed_monthly_rollup(in_cents(views.sales(spark, sf_dir)), materialize_with=materialize)
    return rows.withColumns({"sales_qty": F.col("sales_qty").cast("bigint"), "avg_price": F.col("avg_price") / 100.0})


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.series_features(monthly(spark, sf_dir))


# ------------------------------------------------------------------ queries
def q_monthly_rollup(spark, sf_dir):
    return _round(monthly(spark, sf_dir), ["avg_price"])


FEATURE_FLOATS = ["avg_price", "rolling_3m_mean", "rolling_6m_mean", "rolling_3m_std",
                  "rolling_12m_mean", "month_sin", "month_cos"]


def q_series_features(spark, sf_dir):
    return _round(features(spark, sf_dir), FEATURE_FLOATS)


def sales_with_gaps(spark, sf_dir) -> DataFrame:
    """sales with NULL quantities and prices finer than a cent (in tenths of a cent, so that sums are exact)."""
    s = views.sales(spark, sf_dir)
    q = F.col("sales_qty")
    return s.withColumns({"sales_qty": F.when(q % 10 != 3, q * 2 - F.when(q > 24, 1).otherwise(0)),
                          "price": F.round(F.col("price") * 100).cast("bigint") * 10 + q % 7})


def q_imputed_rollup_with_gaps(spark, sf_dir):
    """F7 + A1 where quantities are missing and the median need not be whole."""
    rows = panel.imputed_monthly_rollup(sales_with_gaps(spark, sf_dir), materialize_with=materialize)
    return _round(rows.withColumn("avg_price", F.col("avg_price") / 1000.0), ["sales_qty", "avg_price"])


def q_null_cell_count(spark, sf_dir):
    return panel.null_cell_count(views.sales(spark, sf_dir))


def q_monthly_total_trend(spark, sf_dir):
    return _round(panel.total_by_date(monthly(spark, sf_dir)), ["rolling_3m"])


def q_product_totals_top3(spark, sf_dir):
    return panel.totals_with_top(monthly(spark, sf_dir), "product", top=3)


def q_seasonality(spark, sf_dir):
    return _round(panel.seasonality(monthly(spark, sf_dir)), ["mean_qty", "ratio_to_mean"])


def q_store_share(spark, sf_dir):
    return _round(panel.share_of_total(monthly(spark, sf_dir), "store"), ["share"])


def q_promotion_effect(spark, sf_dir):
    return _round(panel.promotion_effect(monthly(spark, sf_dir)), ["mean_qty", "lift"])


def q_top_product_history(spark, sf_dir):
    return panel.top_key_history(monthly(spark, sf_dir), "product")


def q_dataset_kpis(spark, sf_dir):
    return panel.dataset_kpis(monthly(spark, sf_dir))


def q_sales_qty_median(spark, sf_dir):
    s = views.sales(spark, sf_dir)
    return s.agg(F.median("sales_qty").alias("median_qty"),
                 F.count(F.lit(1)).alias("n_rows"))


def q_product_upper_quartile(spark, sf_dir):
    totals = monthly(spark, sf_dir).groupBy("product").agg(
        F.sum("sales_qty").cast("bigint").alias("total"))
    return panel.upper_quantile_flag(totals, "total", 0.75)


def q_holdout_split(spark, sf_dir):
    m = monthly(spark, sf_dir)
    return panel.temporal_split(m, 6).select("date", "store", "product", "is_test")


NAIVE_PREDICTORS = (("naive_last", "lag_1m"), ("seasonal_naive", "lag_12m"),
                    ("moving_avg_3", "rolling_3m_mean"))


def naive_predictions(spark, sf_dir) -> DataFrame:
    """Test part of the feature frame scored by three column predictors,
    clipped at zero (F8): a long (model, actual, predicted) table."""
    from tessera.functions.numeric import clip_at_zero
    f = panel.temporal_split(features(spark, sf_dir), 6).where("is_test")
    stack = ", ".join(f"'{m}', CAST({c} AS DOUBLE)" for m, c in NAIVE_PREDICTORS)
    return (f.selectExpr("date", "store", "product", "CAST(sales_qty AS DOUBLE) AS actual",
                         f"stack({len(NAIVE_PREDICTORS)}, {stack}) AS (model, raw_pred)")
             .withColumn("predicted", clip_at_zero("raw_pred")).drop("raw_pred"))


def q_forecast_metrics(spark, sf_dir):
    m = metrics.regression_metrics(naive_predictions(spark, sf_dir), group=["model"])
    m = metrics.flag_best(m, "mape")
    return _round(m, ["mae", "mse", "rmse", "mape", "r2"])


def q_actual_vs_predicted(spark, sf_dir):
    from tessera.functions.numeric import forecast_band, residual
    p = naive_predictions(spark, sf_dir).where(F.col("model") == "naive_last")
    out = panel.actual_vs_predicted(p, actual="actual", predicted="predicted")
    out = out.withColumns(forecast_band(F.col("predicted"))).withColumns(
        residual(F.col("actual"), F.col("predicted")))
    return _round(out, ["actual", "predicted", "lower", "upper", "residual"])


def q_forecast_display_sample(spark, sf_dir):
    p = naive_predictions(spark, sf_dir).where(F.col("model") == "naive_last")
    return metrics.evenly_spaced_sample(p, ["date", "store", "product"], 30) \
                  .select("date", "store", "product", "actual", "predicted")


QUERIES = {
    "monthly_rollup": q_monthly_rollup,
    "imputed_rollup_with_gaps": q_imputed_rollup_with_gaps,
    "series_features": q_series_features,
    "null_cell_count": q_null_cell_count,
    "monthly_total_trend": q_monthly_total_trend,
    "product_totals_top3": q_product_totals_top3,
    "seasonality": q_seasonality,
    "store_share": q_store_share,
    "promotion_effect": q_promotion_effect,
    "top_product_history": q_top_product_history,
    "dataset_kpis": q_dataset_kpis,
    "sales_qty_median": q_sales_qty_median,
    "product_upper_quartile": q_product_upper_quartile,
    "holdout_split": q_holdout_split,
    "forecast_metrics": q_forecast_metrics,
    "actual_vs_predicted": q_actual_vs_predicted,
    "forecast_display_sample": q_forecast_display_sample,
}

# ------------------------------------------------------------------ oracles
MONTHLY_SQL = """
SELECT CAST(date_trunc('month', date) AS DATE) AS date, store, product,
       CAST(coalesce(sum(sales_qty), 0) AS BIGINT) AS sales_qty,
       max(promotion) AS promotion,
       avg(CAST(round(price*100) AS BIGINT)) / 100.0E0 AS avg_price
FROM (SELECT date, store, product,
             coalesce(sales_qty, (SELECT median(sales_qty) FROM sales)) AS sales_qty,
             coalesce(promotion, 0) AS promotion, price FROM sales) s
WHERE date IS NOT NULL AND store IS NOT NULL AND product IS NOT NULL
GROUP BY 1, 2, 3
"""

_W = "PARTITION BY store, product ORDER BY date"


def _roll(k: int, fn: str) -> str:
    frame = f"OVER ({_W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(sales_qty) {frame} = {k} THEN {fn}(sales_qty) {frame} END"


FEATURES_SQL = f"""
SELECT f.*, s.store_enc, p.product_enc FROM (
  SELECT date, store, product, sales_qty, promotion, avg_price,
         lag(sales_qty, 1) OVER ({_W}) AS lag_1m, lag(sales_qty, 2) OVER ({_W}) AS lag_2m,
         lag(sales_qty, 3) OVER ({_W}) AS lag_3m, lag(sales_qty, 6) OVER ({_W}) AS lag_6m,
         lag(sales_qty, 12) OVER ({_W}) AS lag_12m,
         {_roll(3, 'avg')} AS rolling_3m_mean, {_roll(6, 'avg')} AS rolling_6m_mean,
         {_roll(3, 'stddev_samp')} AS rolling_3m_std, {_roll(12, 'avg')} AS rolling_12m_mean,
         CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
         CAST(year(date) AS INTEGER) AS year,
         sin(2*pi()*month(date)/12.0E0) AS month_sin, cos(2*pi()*month(date)/12.0E0) AS month_cos,
         CAST(row_number() OVER ({_W}) - 1 AS INTEGER) AS trend_idx
  FROM monthly) f
LEFT JOIN (SELECT store, CAST(dense_rank() OVER (ORDER BY store) - 1 AS INTEGER) AS store_enc
           FROM (SELECT DISTINCT store FROM monthly)) s USING (store)
LEFT JOIN (SELECT product, CAST(dense_rank() OVER (ORDER BY product) - 1 AS INTEGER) AS product_enc
           FROM (SELECT DISTINCT product FROM monthly)) p USING (product)
"""

FEATURE_COLS_SQL = ("date, store, product, sales_qty, promotion, lag_1m, lag_2m, lag_3m, lag_6m, lag_12m, "
                    "month, quarter, year, trend_idx, store_enc, product_enc")


def _r(cols):
    return ", ".join(f"round({c}, {R}) + 0.0E0 AS {c}" for c in cols)


FEATURES_DROPPED = f"""
SELECT * FROM features_all WHERE lag_1m IS NOT NULL AND lag_2m IS NOT NULL AND lag_3m IS NOT NULL
  AND lag_6m IS NOT NULL AND lag_12m IS NOT NULL AND rolling_3m_mean IS NOT NULL
  AND rolling_6m_mean IS NOT NULL AND rolling_3m_std IS NOT NULL AND rolling_12m_mean IS NOT NULL
  AND avg_price IS NOT NULL AND promotion IS NOT NULL AND store_enc IS NOT NULL AND product_enc IS NOT NULL
"""

_PANEL = {"monthly": MONTHLY_SQL}
_FEAT = {"monthly": MONTHLY_SQL, "features_all": FEATURES_SQL, "features": FEATURES_DROPPED}
_TEST = dict(_FEAT, test_part="""
SELECT * FROM features WHERE date > (SELECT max(date) - INTERVAL 6 MONTH FROM features)
""")
_NAIVE = dict(_TEST, naive="""
SELECT date, store, product, CAST(sales_qty AS DOUBLE) AS actual, model,
       greatest(CAST(raw_pred AS DOUBLE), 0.0E0) AS predicted FROM (
  SELECT date, store, product, sales_qty, 'naive_last' AS model, CAST(lag_1m AS DOUBLE) AS raw_pred FROM test_part
  UNION ALL SELECT date, store, product, sales_qty, 'seasonal_naive', CAST(lag_12m AS DOUBLE) FROM test_part
  UNION ALL SELECT date, store, product, sales_qty, 'moving_avg_3', rolling_3m_mean FROM test_part)
""")

ORACLES = {
    "imputed_rollup_with_gaps": with_views(f"""
SELECT CAST(date_trunc('month', date) AS DATE) AS date, store, product, round(sum(coalesce(q, m)), {R}) + 0.0E0 AS sales_qty,
       max(promotion) AS promotion, round(avg(p) / 1000.0E0, {R}) + 0.0E0 AS avg_price
FROM gaps, (SELECT median(q) AS m FROM gaps) GROUP BY 1, 2, 3""", "sales", extra={"gaps": """
SELECT date, store, product, promotion, CASE WHEN sales_qty % 10 <> 3 THEN sales_qty * 2 - CASE WHEN sales_qty > 24 THEN 1 ELSE 0 END END AS q,
       CAST(round(price*100) AS BIGINT) * 10 + sales_qty % 7 AS p FROM sales"""}),
    "monthly_rollup": with_views(
        f"SELECT date, store, product, sales_qty, promotion, {_r(['avg_price'])} FROM monthly",
        "sales", extra=_PANEL),
    "series_features": with_views(
        f"SELECT {FEATURE_COLS_SQL}, {_r(FEATURE_FLOATS)} FROM features", "sales", extra=_FEAT),
    "null_cell_count": with_views("""
SELECT CAST(sum((date IS NULL)::INT + (store IS NULL)::INT + (product IS NULL)::INT
          + (sales_qty IS NULL)::INT + (promotion IS NULL)::INT + (price IS NULL)::INT) AS BIGINT) AS null_cells,
       count(*) AS n_rows FROM sales""", "sales"),
    "monthly_total_trend": with_views(f"""
SELECT date, sales_qty, {_r(['rolling_3m'])}, CAST(floor(rolling_3m + 0.5) AS BIGINT) AS rolling_3m_int FROM (
  SELECT date, sales_qty,
         CASE WHEN count(sales_qty) OVER w = 3 THEN avg(sales_qty) OVER w END AS rolling_3m
  FROM (SELECT date, CAST(sum(sales_qty) AS BIGINT) AS sales_qty FROM monthly GROUP BY date)
  WINDOW w AS (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""", "sales", extra=_PANEL),
    "product_totals_top3": with_views("""
SELECT product, total, total >= (SELECT min(total) FROM (SELECT total FROM t ORDER BY total DESC LIMIT 3)) AS is_top
FROM t""", "sales", extra=dict(_PANEL, t="SELECT product, CAST(sum(sales_qty) AS BIGINT) AS total FROM monthly GROUP BY product")),
    "seasonality": with_views(f"""
SELECT month_num, {_r(['mean_qty'])}, mean_qty = max(mean_qty) OVER () AS is_peak,
       mean_qty = min(mean_qty) OVER () AS is_trough,
       round(mean_qty / (SELECT avg(sales_qty) FROM monthly), {R}) + 0.0E0 AS ratio_to_mean
FROM (SELECT CAST(month(date) AS INTEGER) AS month_num, avg(sales_qty) AS mean_qty FROM monthly GROUP BY 1)""",
        "sales", extra=_PANEL),
    "store_share": with_views(f"""
SELECT store, total, round(total / CAST((SELECT sum(sales_qty) FROM monthly) AS DOUBLE), {R}) + 0.0E0 AS share
FROM (SELECT store, CAST(sum(sales_qty) AS BIGINT) AS total FROM monthly GROUP BY store)""",
        "sales", extra=_PANEL),
    "promotion_effect": with_views(f"""
SELECT promotion, {_r(['mean_qty'])}, n_rows,
       round(mean_qty / (SELECT avg(sales_qty) FROM monthly WHERE promotion = 0), {R}) + 0.0E0 AS lift
FROM (SELECT promotion, avg(sales_qty) AS mean_qty, count(*) AS n_rows FROM monthly GROUP BY promotion)""",
        "sales", extra=_PANEL),
    "top_product_history": with_views("""
SELECT date, CAST(sum(sales_qty) AS BIGINT) AS sales_qty, product FROM monthly
WHERE product = (SELECT product FROM monthly GROUP BY product ORDER BY sum(sales_qty) DESC, product LIMIT 1)
GROUP BY date, product""", "sales", extra=_PANEL),
    "dataset_kpis": with_views("""
SELECT count(*) AS n_rows, count(DISTINCT product) AS n_products, count(DISTINCT store) AS n_stores,
       min(date) AS first_date, max(date) AS last_date FROM monthly""", "sales", extra=_PANEL),
    "sales_qty_median": with_views(
        "SELECT median(sales_qty)::DOUBLE AS median_qty, count(*) AS n_rows FROM sales", "sales"),
    "product_upper_quartile": with_views("""
SELECT product, total, total >= (SELECT quantile_cont(total, 0.75) FROM t) AS is_upper FROM t""",
        "sales", extra=dict(_PANEL, t="SELECT product, CAST(sum(sales_qty) AS BIGINT) AS total FROM monthly GROUP BY product")),
    "holdout_split": with_views("""
SELECT date, store, product, date > (SELECT max(date) - INTERVAL 6 MONTH FROM monthly) AS is_test FROM monthly""",
        "sales", extra=_PANEL),
    "forecast_metrics": with_views(f"""
SELECT model, n, {_r(['mae', 'mse', 'rmse', 'mape', 'r2'])},
       row_number() OVER (ORDER BY mape, model) = 1 AS best_mape FROM (
  SELECT model, count(*) AS n, avg(abs(actual - predicted)) AS mae,
         avg((actual - predicted)*(actual - predicted)) AS mse,
         sqrt(avg((actual - predicted)*(actual - predicted))) AS rmse,
         avg(abs((actual - predicted) / (actual + 1e-9))) * 100.0 AS mape,
         1.0 - sum((actual - predicted)*(actual - predicted)) / (var_pop(actual) * count(*)) AS r2
  FROM naive GROUP BY model)""", "sales", extra=_NAIVE),
    "actual_vs_predicted": with_views(f"""
SELECT date, {_r(['actual', 'predicted'])}, round(predicted * 0.92, {R}) + 0.0E0 AS lower,
       round(predicted * 1.08, {R}) + 0.0E0 AS upper, round(actual - predicted, {R}) + 0.0E0 AS residual,
       CASE WHEN actual - predicted > 0 THEN 'under' WHEN actual - predicted < 0 THEN 'over' ELSE 'exact' END AS residual_sign
FROM (SELECT date, CAST(sum(actual) AS DOUBLE) AS actual, CAST(sum(predicted) AS DOUBLE) AS predicted
      FROM naive WHERE model = 'naive_last' GROUP BY date)""", "sales", extra=_NAIVE),
    "forecast_display_sample": with_views("""
SELECT date, store, product, actual, predicted FROM (
  SELECT *, row_number() OVER (ORDER BY date, store, product) - 1 AS pos, count(*) OVER () AS n
  FROM naive WHERE model = 'naive_last')
WHERE pos IN (SELECT CAST(floor(i * (n - 1) / (least(n, 30) - 1)) AS BIGINT)
              FROM range(0, 30) r(i), (SELECT count(*) AS n FROM naive WHERE model = 'naive_last')
              WHERE i < least(n, 30))""", "sales", extra=_NAIVE),
}
