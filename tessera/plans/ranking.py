"""Entity rank regression.

profile -> md5 80/20 split -> one standard scaler (population std) ->
perceptron, random forest, gradient boosting -> MAE / MSE / R^2 ->
every entity scored by all three models (the rank simulator in batch form).
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import agreement, truncate_int
from tessera.operators import entities as E
from tessera.operators import metrics, perceptron
from tessera.operators import text as X
from tessera.plans.forecast import TREE_SCHEDULING
from tessera.session import for_fitting, side_by_side

SEED = 42
MLP_HIDDEN, MLP_STEPS = (50, 25), 60
RF_TREES, RF_DEPTH = 100, 10
GBT_ITERS, GBT_DEPTH, GBT_RATE = 100, 5, 0.1
MODEL_ORDER = ("MLP", "Random Forest", "Gradient Boosting")


def prepare(profile: DataFrame, features=E.FEATURES) -> DataFrame:
    scaled = E.standard_scale(profile, features)
    vec = VectorAssembler(inputCols=[f"{f}_z" for f in features], outputCol="features")
    out = vec.transform(scaled).withColumn("label", F.col("hec_rank").cast("double"))
    out = out.withColumn("inputs", F.array(*[F.col(f"{f}_z") for f in features]))
    return X.hash_split(out, "entity")


def fitting_frame(profile: DataFrame) -> DataFrame:
    return for_fitting(prepare(profile), "entity")


def forest():
    return RandomForestRegressor(numTrees=RF_TREES, maxDepth=RF_DEPTH, featureSubsetStrategy="all", seed=SEED, **TREE_SCHEDULING)


def fit_models(data: DataFrame) -> dict:
    """The three models, fitted side by side."""
    boosted = GBTRegressor(maxIter=GBT_ITERS, maxDepth=GBT_DEPTH, stepSize=GBT_RATE, seed=SEED, checkpointInterval=5)
    return side_by_side({"MLP": lambda: perceptron.fit(data, "inputs", "label", hidden=MLP_HIDDEN, steps=MLP_STEPS, seed=SEED),
                         "Random Forest": lambda: forest().fit(data), "Gradient Boosting": lambda: boosted.fit(data)})


def feature_importance(data: DataFrame) -> DataFrame:
    """M19 of the forest fitted on all entities (four numbers, from the model on the driver)."""
    model = forest().fit(data)
    rows = [(f, float(v)) for f, v in zip(E.FEATURES, model.featureImportances.toArray(), strict=True)]
    return data.sparkSession.createDataFrame(rows, "feature string, importance double")


def score_all(models: dict, df: DataFrame) -> DataFrame:
    d = df.withColumn("pred_mlp", models["MLP"].predict(F.col("inputs")))
    d = models["Random Forest"].transform(d).withColumnRenamed("prediction", "pred_rf")
    return models["Gradient Boosting"].transform(d).withColumnRenamed("prediction", "pred_gb")


def evaluate(data: DataFrame) -> DataFrame:
    """M15 + M18: MAE, MSE, R^2 per model on the held-out part, best by R^2."""
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    scored = score_all(fit_models(train), test)
    long = scored.selectExpr("label AS actual",
                             "stack(3, 'MLP', pred_mlp, 'Random Forest', pred_rf, "
                             "'Gradient Boosting', pred_gb) AS (model, predicted)")
    m = metrics.regression_metrics(long, group=["model"]).select("model", "n", "mae", "mse", "r2")
    order = F.array_position(F.array(*[F.lit(x) for x in MODEL_ORDER]), F.col("model"))
    return metrics.flag_best(m.withColumn("model_order", order), "r2", lower_is_better=False,
                             order_col="model_order").drop("model_order")


def simulate(models, data: DataFrame) -> DataFrame:
    """M20 + F21: models fitted on all entities score every entity's
    features; predictions truncated to int, with their agreement."""
    scored = score_all(models, data)
    ints = {c: truncate_int(F.col(c)) for c in ("pred_mlp", "pred_rf", "pred_gb")}
    s = scored.withColumns(ints)
    return s.select("entity", F.col("hec_rank"), "pred_mlp", "pred_rf", "pred_gb",
                    *[v.alias(k) for k, v in agreement("pred_mlp", "pred_rf", "pred_gb").items()])


def closest(data: DataFrame, profile: DataFrame, point: dict[str, float], k: int = 5) -> DataFrame:
    """R5 + P10 on a predicted rank: the entities closest to the rank that the
    model best on the held-out part, fitted again on all entities, gives a
    point of scores."""
    best = evaluate(data).where("best_r2").first()["model"]
    st = E._stats_scalar(E.scaling_stats(profile))
    one = profile.sparkSession.range(1).select(*[E._z(F.lit(float(point[f])), st, f).alias(f"{f}_z") for f in E.FEATURES])
    one = VectorAssembler(inputCols=[f"{f}_z" for f in E.FEATURES], outputCol="features").transform(one)
    one = one.withColumn("inputs", F.array(*[F.col(f"{f}_z") for f in E.FEATURES]))
    column = dict(zip(MODEL_ORDER, ("pred_mlp", "pred_rf", "pred_gb"), strict=True))[best]
    rank = score_all(fit_models(data), one).select(truncate_int(F.col(column)).alias("r")).first()["r"]
    return E.closest_by_rank(profile.withColumn("predicted_rank", F.lit(rank)), F.col("predicted_rank"), k).select(
        "entity", F.lit(best).alias("model"), "predicted_rank", "hec_rank", "rank_diff", "verdict")
