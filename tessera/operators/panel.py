"""Panel time-series operators: rollups, series windows and EDA aggregates.

Plan shape at scale
-------------------
* ``monthly_rollup`` is one hash aggregate with a map-side partial step, so
  the shuffle carries at most (groups x map tasks) rows however hot a key
  is.
* Every per-series feature (lags, guarded rolling stats, position) uses the
  *same* window spec, so Spark plans one exchange on the series key and one
  sort.  Series hold one row per month, so no window partition can grow
  with the raw data.
* Global statistics (median, cutoff date, totals) are scalar subqueries
  (``DataFrame.scalar()``), evaluated once and inlined as a literal: no
  cross join and no single-partition window over raw rows.
* Windows without a partition key run only over already-aggregated rows
  whose count is bounded by a calendar or category domain (12 months,
  months in range, distinct stores/products).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import calendar_parts, cyclic_month, month_start, shift_months

SERIES_KEYS = ("store", "product")
# Lags, trailing windows and feature names of the forecast.
LAGS = (1, 2, 3, 6, 12)
# (output column, frame length, statistic) for the trailing windows that
# exclude the current row.
ROLLING = (("rolling_3m_mean", 3, "mean"), ("rolling_6m_mean", 6, "mean"),
           ("rolling_3m_std", 3, "std"), ("rolling_12m_mean", 12, "mean"))

FEATURE_COLS = (
    "lag_1m", "lag_2m", "lag_3m", "lag_6m", "lag_12m",
    "rolling_3m_mean", "rolling_6m_mean", "rolling_3m_std", "rolling_12m_mean",
    "month", "quarter", "year", "month_sin", "month_cos",
    "trend_idx", "promotion", "avg_price", "store_enc", "product_enc")


# --------------------------------------------------------------------- F7 / A20
def median_of(df: DataFrame, col: str, approx_accuracy: int | None = None) -> Column:
    """Median as a scalar subquery.

    Exact by default: Spark's percentile buffer is a value->count map, so
    memory follows the number of distinct values, not rows (quantities are
    small integers).  For a high-cardinality column pass
    ``approx_accuracy`` (e.g. 10000) to use ``percentile_approx``, whose
    sketch has a fixed size whatever the input.
    """
    if approx_accuracy:
        return df.select(F.percentile_approx(col, 0.5, approx_accuracy)).scalar()
    return df.select(F.median(col)).scalar()


def impute_sales(df: DataFrame, qty: str = "sales_qty", promo: str = "promotion") -> DataFrame:
    """fill missing quantities with the overall median, promotions with 0."""
    med = median_of(df, qty)
    out = df.withColumn(qty, F.coalesce(F.col(qty).cast("double"), med))
    if promo in df.columns:
        out = out.withColumn(promo, F.coalesce(F.col(promo), F.lit(0)))
    return out


# ------------------------------------------------------------------------ A1
def monthly_rollup(sales: DataFrame, keys=SERIES_KEYS, date: str = "date") -> DataFrame:
    """A1: sum qty, max promotion, mean price per (month, *keys).

    Null keys are dropped first (a grouped pandas frame drops them), and an
    all-null quantity sums to 0, not NULL.
    """
    valid = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (date, *keys)])
    aggs = [F.coalesce(F.sum("sales_qty"), F.lit(0)).alias("sales_qty")]
    if "promotion" in sales.columns:
        aggs.append(F.max("promotion").alias("promotion"))
    if "price" in sales.columns:
        aggs.append(F.avg("price").alias("avg_price"))
    return (sales.where(valid)
                 .groupBy(month_start(date).alias(date), *keys)
                 .agg(*aggs))


def imputed_monthly_rollup(sales: DataFrame, keys=SERIES_KEYS, date: str = "date",
                           qty: str = "sales_qty", promo: str = "promotion",
                           price: str = "price", materialize_with=None) -> DataFrame:
    """F7 + A1 in ONE pass over the (joined) sales input.

    Median imputation needs the median of all quantities before the rollup;
    computing it as a separate subquery would run the lineitem joins twice.
    Instead one ``GROUPING SETS`` aggregate produces both the monthly groups
    (sum, NULL count, max promotion, mean price) and the quantity histogram
    (value -> count, bounded by the number of distinct quantities).  The
    median comes from the histogram, and each group adds
    ``n_null * median`` to its sum -- the same result as imputing first.

    ``materialize_with`` (e.g. ``session.materialize``) stores the small
    aggregate so the histogram and the groups are read from it.
    """
    d = month_start(date).alias(date)
    pre = sales.select(d, *keys, F.col(qty), F.coalesce(F.col(promo), F.lit(0)).alias(promo), F.col(price))
    agg = (pre.groupingSets([[date, *keys], [qty]], date, *keys, qty)
              .agg(F.grouping_id().alias("_gid"), F.sum(qty).alias("_sum"),
                   F.count_if(F.col(qty).isNull()).alias("_nnull"), F.max(promo).alias(promo),
                   F.avg(price).alias("avg_price"),
                   F.count(F.lit(1)).alias("_n")))
    if materialize_with is not None:
        agg = materialize_with(agg)
    n_keys = len(keys) + 1
    groups_gid, hist_gid = 1, (1 << (n_keys + 1)) - 2  # bit order: date, *keys, qty
    hist = agg.where((F.col("_gid") == hist_gid) & F.col(qty).isNotNull()).select(qty, "_n")
    med = _median_from_histogram(hist, qty, "_n")
    valid = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (date, *keys)])
    total = F.coalesce(F.col("_sum"), F.lit(0)).cast("double") + F.col("_nnull") * F.coalesce(med, F.lit(0.0))
    return (agg.where((F.col("_gid") == groups_gid) & valid)
               .select(date, *keys, total.alias(qty), promo, "avg_price"))


def _median_from_histogram(hist: DataFrame, value: str, count: str) -> Column:
    """Exact median from (value, count) rows, as a scalar subquery.

    The window runs over the distinct values only (a histogram).
    """
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("_cum", F.sum(count).over(w)).withColumn(
        "_tot", F.sum(count).over(Window.partitionBy()))
    lo = (F.col("_tot") - 1) / 2  # 0-based middle positions (floor / ceil)
    lo_i, hi_i = F.floor(lo), F.ceil(lo)
    pick = cum.select(
        F.min(F.when(F.col("_cum") > lo_i, F.col(value))).alias("a"),
        F.min(F.when(F.col("_cum") > hi_i, F.col(value))).alias("b"))
    return pick.select((F.col("a") + F.col("b")) / 2.0).scalar()


# ------------------------------------------------------------------------ F9
def code_table(domain_of: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """F9 fit: (value, code) with code = position in the sorted distinct domain.

    The ranking window runs over the *distinct* values only (a category
    domain, e.g. stores or product types), never over raw rows.
    """
    out = out or f"{col}_enc"
    return (domain_of.select(col).where(F.col(col).isNotNull()).distinct()
                     .withColumn(out, (F.dense_rank().over(Window.orderBy(col)) - 1).cast("int")))


def label_codes(df: DataFrame, col: str, out: str | None = None,
                domain_of: DataFrame | None = None) -> DataFrame:
    """attach codes fitted on ``domain_of`` (default: ``df`` itself).

    Pass the frame the features were built from as ``domain_of`` so the code
    table shares its lineage: Spark then reuses that frame's shuffle output
    instead of recomputing it.  The code table joins back by value; the
    planner broadcasts it when its runtime size allows.
    """
    codes = code_table(domain_of if domain_of is not None else df, col, out)
    return df.join(codes, on=col, how="left")


# -------------------------------------------------------------- W1-W3, W6
def series_features(monthly: DataFrame, keys=SERIES_KEYS, date: str = "date",
                    value: str = "sales_qty", lags=LAGS, rolling=ROLLING,
                    encode: bool = True, drop_incomplete: bool = True) -> DataFrame:
    """The forecast feature frame.

    Lags count rows, not calendar months (a missing month compresses the
    series).  Rolling statistics cover the k previous rows and are NULL until
    all k exist (pandas ``rolling(k)``), never a partial average.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    cols = {f"lag_{k}m": F.lag(value, k).over(w) for k in lags}
    for name, k, stat in rolling:
        frame = w.rowsBetween(-k, -1)
        full = F.count(value).over(frame) == k
        agg = F.avg(value) if stat == "mean" else F.stddev_samp(value)
        cols[name] = F.when(full, agg.over(frame))
    cal = calendar_parts(date)
    cols.update(cal)
    out = monthly.withColumns(cols)
    out = out.withColumns(cyclic_month(F.col("month")))
    out = out.withColumn("trend_idx", (F.row_number().over(w) - 1).cast("int"))
    if encode:
        for k in keys:
            out = label_codes(out, k, domain_of=monthly)
    if drop_incomplete:
        out = out.na.drop("any", subset=[c for c in out.columns if c != value])
    return out


# ------------------------------------------------------------------- M1 / F6
def holdout_cutoff(df: DataFrame, months: int = 6, date: str = "date") -> Column:
    """Cutoff = max(date) - n calendar months, as a scalar subquery."""
    return df.select(shift_months(F.max(date), -months)).scalar()


def temporal_split(df: DataFrame, months: int = 6, date: str = "date",
                   flag: str = "is_test") -> DataFrame:
    """M1: rows after (max date - n months) are the test part."""
    cutoff = holdout_cutoff(df, months, date)
    return df.withColumn(flag, F.col(date) > cutoff)


# ------------------------------------------------------------------- A2-A10
def null_cell_count(df: DataFrame) -> DataFrame:
    """A2: total NULL cells over all columns, in one pass."""
    parts = [F.count_if(F.col(c).isNull()) for c in df.columns]
    return df.agg(reduce(lambda a, b: a + b, parts).cast("bigint").alias("null_cells"),
                  F.count(F.lit(1)).alias("n_rows"))


def total_by_date(monthly: DataFrame, date: str = "date", value: str = "sales_qty") -> DataFrame:
    """A3 + W4 + W5: total per date, 3-period trailing mean (current row
    included, NULL for the first two) and that mean rounded half-up.

    The window has no partition key on purpose: it runs over one row per
    date, after the aggregation.
    """
    agg = monthly.groupBy(date).agg(F.sum(value).cast("bigint").alias(value))
    w = Window.orderBy(date).rowsBetween(-2, 0)
    mean3 = F.when(F.count(value).over(w) == 3, F.avg(value).over(w))
    return (agg.withColumn("rolling_3m", mean3)
               .withColumn("rolling_3m_int", F.floor(F.col("rolling_3m") + 0.5).cast("bigint")))


def totals_with_top(monthly: DataFrame, key: str = "product", value: str = "sales_qty",
                    top: int = 3) -> DataFrame:
    """A4: total per key with a top-n flag (rank semantics: total >= n-th largest).

    The n-th largest total is a scalar subquery over a distributed top-n, so
    no window has to see every key in one partition.
    """
    totals = monthly.groupBy(key).agg(F.sum(value).cast("bigint").alias("total"))
    nth = (totals.orderBy(F.desc("total")).limit(top)
                 .select(F.min("total")).scalar())
    return totals.withColumn("is_top", F.col("total") >= nth)


def seasonality(monthly: DataFrame, date: str = "date", value: str = "sales_qty") -> DataFrame:
    """A5: mean per calendar month (<= 12 rows), peak/trough flags and the
    ratio to the mean over all rows."""
    overall = monthly.select(F.avg(value)).scalar()
    s = monthly.groupBy(F.month(date).alias("month_num")).agg(F.avg(value).alias("mean_qty"))
    w = Window.partitionBy()  # <= 12 rows by construction
    return (s.withColumn("is_peak", F.col("mean_qty") == F.max("mean_qty").over(w))
             .withColumn("is_trough", F.col("mean_qty") == F.min("mean_qty").over(w))
             .withColumn("ratio_to_mean", F.try_divide(F.col("mean_qty"), overall)))


def share_of_total(monthly: DataFrame, key: str = "store", value: str = "sales_qty") -> DataFrame:
    """Total per key and its share of the grand total."""
    grand = monthly.select(F.sum(value)).scalar()
    return (monthly.groupBy(key).agg(F.sum(value).cast("bigint").alias("total"))
                   .withColumn("share", F.try_divide(F.col("total"), grand.cast("double"))))


def promotion_effect(monthly: DataFrame, value: str = "sales_qty") -> DataFrame:
    """Mean quantity with and without promotion, and the lift ratio."""
    base = monthly.where(F.col("promotion") == 0).select(F.avg(value)).scalar()
    return (monthly.groupBy("promotion").agg(F.avg(value).alias("mean_qty"),
                                             F.count(F.lit(1)).alias("n_rows"))
                   .withColumn("lift", F.try_divide(F.col("mean_qty"), base)))


def actual_vs_predicted(pred: DataFrame, date: str = "date", actual: str = "sales_qty",
                        predicted: str = "predicted") -> DataFrame:
    """Summed actual and predicted per date."""
    return pred.groupBy(date).agg(F.sum(actual).cast("double").alias("actual"),
                                  F.sum(predicted).cast("double").alias("predicted"))


def top_key(monthly: DataFrame, key: str = "product", value: str = "sales_qty") -> Column:
    """Argmax key by total (ties -> smallest key), as a scalar subquery."""
    totals = monthly.groupBy(key).agg(F.sum(value).alias("total"))
    return totals.orderBy(F.desc("total"), F.asc(key)).limit(1).select(key).scalar()


def top_key_history(monthly: DataFrame, key: str = "product", date: str = "date",
                    value: str = "sales_qty") -> DataFrame:
    """Monthly totals of the top key."""
    best = top_key(monthly, key, value)
    return (monthly.where(F.col(key) == best)
                   .groupBy(date).agg(F.sum(value).cast("bigint").alias(value))
                   .withColumn(key, best))


def dataset_kpis(monthly: DataFrame, date: str = "date", approx: bool = False) -> DataFrame:
    """A10: rows, distinct products and stores, first and last date."""
    distinct = (lambda c: F.approx_count_distinct(c)) if approx else F.count_distinct
    return monthly.agg(F.count(F.lit(1)).alias("n_rows"),
                       distinct("product").alias("n_products"),
                       distinct("store").alias("n_stores"),
                       F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def upper_quantile_flag(df: DataFrame, col: str, q: float = 0.75, flag: str = "is_upper") -> DataFrame:
    """Flag rows at or above the q-quantile (linear interpolation)."""
    cut = df.select(F.percentile(col, q)).scalar()
    return df.withColumn(flag, F.col(col) >= cut)
