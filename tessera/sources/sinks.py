"""Writers (IO6-IO8): CSV tables, the JSON run summary, prediction exports.

Outputs are written by the executors in parallel (one file per partition),
never collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import evenly_spaced_sample
from tessera.sources.contracts import CSV


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO6: CSV with a header row, no index column.  ``read_csv`` gives the same
    rows back: quotes are doubled, a null is an empty field and an empty text ``""``."""
    df.write.mode(mode).options(**CSV).csv(path)


def summary_frame(monthly: DataFrame, comparison: DataFrame, best_model,
                  date: str = "date", value: str = "sales_qty", predictions: DataFrame | None = None) -> DataFrame:
    """IO7: one-row summary: dataset KPIs, per-model metrics, best model, and
    the total per month; with ``predictions`` (date, store, product, actual,
    predicted) also 30 evenly spaced ones.

    ``comparison`` has one row per model; it is folded into an array of
    structs with ``collect_list`` (a handful of rows), the KPIs are one
    aggregate row, and they meet through scalar subqueries.
    """
    kpis = monthly.agg(F.count(F.lit(1)).alias("rows"),
                       F.count_distinct("product").alias("products"),
                       F.count_distinct("store").alias("stores"),
                       F.date_format(F.min(date), "yyyy-MM").alias("date_from"),
                       F.date_format(F.max(date), "yyyy-MM").alias("date_to"),
                       F.sum(value).alias("total_units"))
    models = comparison.select(F.sort_array(F.collect_list(F.struct(*comparison.columns))).alias("models"))
    best = best_model if not isinstance(best_model, str) else F.lit(best_model)
    by_month = monthly.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.sum(value).alias("units"))
    parts = {"monthly_sales": by_month.select(F.sort_array(F.collect_list(F.struct("month", "units"))))}  # one row a month
    if predictions is not None:
        shown = evenly_spaced_sample(predictions, ["date", "store", "product"], 30)
        parts["pred_vs_actual"] = shown.select(F.sort_array(F.collect_list(F.struct("date", "store", "product", "actual", "predicted"))))
    return kpis.select(F.struct(*kpis.columns).alias("dataset"),
                       models.scalar().alias("models"),
                       best.alias("best_model"),
                       *[p.scalar().alias(name) for name, p in parts.items()])


def write_json_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO7: the one-row summary as JSON (a single small file)."""
    summary.coalesce(1).write.mode(mode).json(path)


def export_predictions(test_rows: DataFrame, path: str, predicted: str = "predicted") -> None:
    """IO8: held-out rows with their prediction attached, as CSV.

    ``model.transform`` keeps every input column next to the prediction, so
    no positional attach (J2) is needed.
    """
    write_csv(test_rows.drop("features") if "features" in test_rows.columns else test_rows, path)
