"""Evaluation operators: regression and classification metrics, best-model
pick, confusion matrix and the evenly spaced display sample (M14-M18, S6, S8).

All metrics are single ``agg`` passes (partial aggregation per partition), so
evaluating a prediction table of any size is one shuffle of a few rows per
group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAPE_EPS = 1e-9


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regression_metrics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       group: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """M14 + M15: n, MAE, MSE, RMSE, MAPE (%) and R^2 per group.

    MAPE divides by (actual + 1e-9), so a zero actual dominates it, as in
    the reference formula.  R^2 = 1 - SS_res / SS_tot with SS_tot from the
    numerically stable population variance.
    """
    y, p = _c(actual).cast("double"), _c(predicted).cast("double")
    err = y - p
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        (F.avg(F.abs(err / (y + F.lit(MAPE_EPS)))) * 100.0).alias("mape"),
        F.sum(err * err).alias("_ss_res"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_ss_tot"),
    ]
    out = pred.groupBy(*group).agg(*aggs) if group else pred.agg(*aggs)
    return (out.withColumn("rmse", F.sqrt("mse"))
               .withColumn("r2", F.lit(1.0) - F.try_divide(F.col("_ss_res"), F.col("_ss_tot")))
               .drop("_ss_res", "_ss_tot"))


def flag_best(metrics: DataFrame, metric: str, model: str = "model", lower_is_better: bool = True,
              order_col: str | None = None, flag: str | None = None) -> DataFrame:
    """Flag the best model by one metric; ties go to the first model
    (``order_col``, else the model name).  Runs over one row per model."""
    flag = flag or f"best_{metric}"
    m = F.col(metric).asc() if lower_is_better else F.col(metric).desc()
    tie = F.col(order_col).asc() if order_col else F.col(model).asc()
    w = Window.orderBy(m, tie)  # one row per model: a handful of rows
    return metrics.withColumn(flag, F.row_number().over(w) == 1)


def accuracy(pred: DataFrame, label: str = "label", predicted: str = "prediction",
             group: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Accuracy in percent, rounded half-even to 2 digits."""
    acc = F.bround(F.avg((F.col(label) == F.col(predicted)).cast("double")) * 100.0, 2)
    aggs = [acc.alias("accuracy"), F.count(F.lit(1)).alias("n")]
    return pred.groupBy(*group).agg(*aggs) if group else pred.agg(*aggs)


def confusion_matrix(pred: DataFrame, labels, label: str = "label",
                     predicted: str = "prediction") -> DataFrame:
    """rows = actual label, one column per predicted label (0-filled).

    ``labels`` is the known label domain, so ``pivot`` needs no extra
    distinct job and empty cells become 0.
    """
    cells = (pred.groupBy(label).pivot(predicted, list(labels)).count()
                 .na.fill(0))
    return cells.select(label, *[F.col(str(v)).cast("bigint").alias(f"pred_{v}") for v in labels])


def confusion_long(pred: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """M17 long form: (actual, predicted, n)."""
    return pred.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")) \
               .agg(F.count(F.lit(1)).alias("n"))


def evenly_spaced_sample(df: DataFrame, order: list[str], max_rows: int = 30) -> DataFrame:
    """Rows at positions floor(i*(n-1)/(m-1)), i < m = min(max_rows, n).

    A row's position is the number of rows with a smaller first order column
    (from one count per distinct value, e.g. a date) plus its row number among
    those that share it, so no task sorts all rows.  The kept positions are an
    arithmetic rule, evaluated per row.
    """
    n = df.select(F.count(F.lit(1))).scalar()
    m = F.least(n, F.lit(max_rows))
    lead, rest = order[0], order[1:] or [order[0]]
    ahead = Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)  # one row per value
    counts = df.groupBy(F.col(lead).alias("_lead")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_lead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    placed = df.join(counts, F.col(lead).eqNullSafe(F.col("_lead"))).withColumn(
        "_pos", F.col("_before") + F.row_number().over(Window.partitionBy(lead).orderBy(*rest)) - 1)
    pos = F.col("_pos")
    # position p is kept iff some i in [0, m) has floor(i*(n-1)/(m-1)) == p;
    # with step s = (n-1)/(m-1) >= 1 that i is ceil(p/s) and must map back to p.
    i = F.ceil(pos * (m - 1) / F.greatest(n - 1, F.lit(1)))
    keep = F.when(m <= 1, pos == 0).otherwise(F.floor(i * (n - 1) / (m - 1)) == pos)
    return placed.where(keep).select(*df.columns)
