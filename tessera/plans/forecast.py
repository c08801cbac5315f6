"""Demand-forecast flow on Spark ML.

sales view -> monthly rollup (checkpointed) -> series features -> temporal
hold-out -> one fit per model -> predictions clipped at 0 -> metrics.

The feature frame is bounded by (series x months), not by raw rows, so the
fits run on a small cached frame whatever the size of lineitem; the heavy
part (scan + joins + rollup) runs once, before the checkpoint.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import clip_at_zero
from tessera.operators import display, metrics, panel
from tessera.sources.contracts import min_rows
from tessera.session import TREE_AGGREGATION_MB, ensure_checkpoint_dir, for_fitting, side_by_side

# Reference hyper-parameters of the batch forecast run.
RF_TREES, RF_DEPTH, RF_MIN_LEAF = 200, 12, 5
GBT_ITERS, GBT_DEPTH, GBT_RATE = 200, 5, 0.05
SEED = 42
MODEL_ORDER = ("Linear Regression", "Random Forest", "Gradient Boosting")
MIN_ROWS = 20  # fewer rows after the selections: refuse to train (P7)
# Fixed settings for deep forests: cache each row's node id between levels and
# group nodes in a fixed amount of memory.  Shallow boosted trees find a row's node
# faster than they read it back.
TREE_SCHEDULING = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": TREE_AGGREGATION_MB}


def feature_columns(use_promotion: bool = True) -> list[str]:
    cols = list(panel.FEATURE_COLS)
    if not use_promotion:
        cols.remove("promotion")
    return cols


def estimators(trees: int = RF_TREES, gbt_iters: int = GBT_ITERS):
    """The three regressors with the reference's settings (sklearn's forest
    regressor considers every feature per split -> featureSubsetStrategy all)."""
    return {
        "Linear Regression": LinearRegression(regParam=0.0, elasticNetParam=0.0),
        "Random Forest": RandomForestRegressor(numTrees=trees, maxDepth=RF_DEPTH,
                                               minInstancesPerNode=RF_MIN_LEAF,
                                               featureSubsetStrategy="all", seed=SEED, **TREE_SCHEDULING),
        "Gradient Boosting": GBTRegressor(maxIter=gbt_iters, maxDepth=GBT_DEPTH, stepSize=GBT_RATE,
                                          lossType="squared", seed=SEED, checkpointInterval=5),
    }


def fit_and_score(features: DataFrame, holdout_months: int = 6, use_promotion: bool = True,
                  trees: int = RF_TREES, gbt_iters: int = GBT_ITERS, selections: dict | None = None,
                  wanted: tuple[str, ...] = MODEL_ORDER):
    """Returns (predictions long table, fitted models, feature names) of the
    ``wanted`` models, which are fitted side by side.

    predictions: date, store, product, model, actual, predicted (clipped).
    ``selections`` ({"store": ..., "product": ...}, "All..." = no filter)
    reproduce the interactive path: the encodings were fitted on every row
    before the filter, and the hold-out cutoff comes from the filtered rows.
    """
    ensure_checkpoint_dir(features.sparkSession)
    cols = feature_columns(use_promotion)
    if selections:
        features = min_rows(display.filter_equals(features, selections), MIN_ROWS)
    split = panel.temporal_split(features, holdout_months)
    data = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error") \
        .transform(split).select("date", "store", "product", "features",
                                 F.col("sales_qty").cast("double").alias("label"), "is_test")
    data = for_fitting(data, "store", "product", "date")
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    asked = {name: est for name, est in estimators(trees, gbt_iters).items() if name in wanted}
    models = side_by_side({name: lambda est=est: est.fit(train) for name, est in asked.items()})
    preds = []
    for name, model in models.items():
        p = model.transform(test).select(
            "date", "store", "product", F.lit(name).alias("model"),
            F.col("label").alias("actual"), clip_at_zero("prediction").alias("predicted"))
        preds.append(p)
    out = preds[0]
    for p in preds[1:]:
        out = out.unionByName(p)
    return out, models, cols


def comparison(preds: DataFrame) -> DataFrame:
    """M18 + S6: one metrics row per model, best by MAPE (ties: model order)."""
    m = metrics.regression_metrics(preds, group=["model"])
    order = F.array_position(F.array(*[F.lit(x) for x in MODEL_ORDER]), F.col("model"))
    m = m.withColumn("model_order", order)
    m = metrics.flag_best(m, "mape", order_col="model_order")
    m = metrics.flag_best(m, "rmse", order_col="model_order")
    return m.withColumns({c: F.bround(c, 2) for c in ("mae", "rmse", "mape")}).drop("model_order")


def feature_importance(spark, model, names, top: int = 12) -> DataFrame:
    """M19 + S7 + A19: importances of a tree model, top-n, upper-quartile flag.

    The importance vector has one entry per feature (19), created on the
    driver from the fitted model, which is where it lives.
    """
    imp = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
    df = spark.createDataFrame(imp, "feature string, importance double")
    df = panel.upper_quantile_flag(df, "importance", 0.75, "is_upper_quartile")
    return df.orderBy(F.desc("importance"), F.asc("feature")).limit(top)
