"""Model tests with tolerances (Spark ML is not bit-comparable to sklearn)."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.plans import sentiment, text_queries
from tessera.session import fitting_scope
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.5 * x[:, 2] + rng.normal(scale=0.1, size=300)
    rows = [(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache(), x, y


def test_ols_matches_lstsq(signal):
    df, x, y = signal
    pred = LinearRegression(regParam=0.0).fit(df).transform(df).select("prediction").collect()
    design = np.column_stack([x, np.ones(len(x))])
    coef, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert np.allclose([r[0] for r in pred], design @ coef, atol=1e-6)


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_trees_beat_mean_predictor(signal, kind):
    df, _, y = signal
    est = (RandomForestRegressor(numTrees=20, maxDepth=6, seed=42) if kind == "forest"
           else GBTRegressor(maxIter=20, maxDepth=3, seed=42))
    out = est.fit(df).transform(df).select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    m = metrics.regression_metrics(out).first()
    assert m.mse < np.var(y) * 0.5


def test_forest_is_reproducible_with_seed(signal):
    df, _, _ = signal
    est = RandomForestRegressor(numTrees=10, maxDepth=4, seed=42)
    a = [r[0] for r in est.fit(df).transform(df).select("prediction").collect()]
    b = [r[0] for r in est.fit(df).transform(df).select("prediction").collect()]
    assert a == b


def test_single_class_input_raises_before_fit(spark):
    r = text_queries.scored_reviews(spark, SF_SMALL).where(F.col("sentiment") == "Positive")
    with pytest.raises(ValueError):
        sentiment.fit_and_score(r)


def test_sentiment_flow_runs_and_scores_every_test_doc(spark):
    with fitting_scope():
        preds = sentiment.fit_and_score(text_queries.scored_reviews(spark, SF_SMALL)).cache()
        n_test = text_queries.labelled_split(spark, SF_SMALL).where("is_test").count()
        counts = {r.model: r["count"] for r in preds.groupBy("model").count().collect()}
        assert set(counts) == set(sentiment.MODEL_ORDER)
        assert all(c == n_test for c in counts.values())
        comp = sentiment.comparison(preds).collect()
        assert sum(r.best_accuracy for r in comp) == 1


def test_forecast_refuses_tiny_selection(spark):
    from tessera.plans import forecast, panel_queries
    feats = panel_queries.features(spark, SF_SMALL)
    with pytest.raises(ValueError):
        forecast.fit_and_score(feats, selections={"store": "no such store"})


def test_forecast_flow_feeds_every_report(spark, monkeypatch):
    """The real flow (fewer trees and rounds): the reports agree with its predictions, and each fits only the models it reads."""
    import json

    from tessera.plans import forecast, ml_queries
    fit = forecast.fit_and_score
    calls = []
    monkeypatch.setattr(forecast, "fit_and_score", lambda f, wanted: calls.append(wanted) or fit(f, trees=5, gbt_iters=3, wanted=wanted))
    compared = {r.model: r for r in ml_queries.q_forecast_model_comparison(spark, SF_SMALL).collect()}
    best = next(m for m, r in compared.items() if r.best_mape)
    preds = [r for r in ml_queries._forecast(spark, SF_SMALL)["preds"].collect() if r.model == best]
    assert abs(sum(abs(r.actual - r.predicted) for r in preds) / len(preds) - compared[best].mae) < 0.01
    months = {r.date: r for r in ml_queries.q_forecast_actual_vs_predicted(spark, SF_SMALL).collect()}
    assert all(abs(sum(r.predicted for r in preds if r.date == d) - m.predicted) < 1e-3 for d, m in months.items())
    top = ml_queries.q_forecast_top_product(spark, SF_SMALL).collect()
    assert all(r.predicted is None or abs(r.upper - 1.08 * r.predicted) < 1e-3 for r in top)
    assert {r.date for r in top if r.predicted is not None} <= set(months)
    summary = json.loads(ml_queries.q_forecast_summary(spark, SF_SMALL).first().summary)
    assert summary["best_model"] == best and len(summary["pred_vs_actual"]) == min(30, len(preds)) and summary["monthly_sales"]
    exported = ml_queries.q_forecast_export(spark, SF_SMALL).collect()
    assert sorted((r.date, r.store, r.product) for r in exported) == sorted((r.date, r.store, r.product) for r in preds)
    assert len(ml_queries.q_forecast_feature_importance(spark, SF_SMALL).collect()) == 12 and calls[-1] == ("Random Forest",)


def test_rank_flow(spark, monkeypatch):
    from tessera.plans import entity_queries, ml_queries, ranking
    for name, value in (("RF_TREES", 5), ("GBT_ITERS", 3), ("MLP_STEPS", 5)):
        monkeypatch.setattr(ranking, name, value)
    assert {r.model for r in ml_queries.q_rank_model_comparison(spark, SF_SMALL).collect()} == set(ranking.MODEL_ORDER)
    simulated = ml_queries.q_rank_simulation(spark, SF_SMALL).collect()
    assert len(simulated) == entity_queries.profile(spark, SF_SMALL).count()
    close = ml_queries.q_rank_closest_entities(spark, SF_SMALL).collect()
    assert len(close) == 5 and all(abs(abs(r.hec_rank - r.predicted_rank) - r.rank_diff) < 1e-6 for r in close)


@pytest.fixture(scope="module")
def curved(spark):
    """Labels that no linear model fits, and some rows that take no part."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = 10 + 5 * np.abs(x[:, 0]) - 3 * x[:, 1] * (x[:, 2] > 0)
    rows = [(i, [float(v) for v in a], float(t)) for i, (a, t) in enumerate(zip(x, y, strict=True))]
    rows += [(900, None, 1.0), (901, [0.0, 0.0, 0.0], None)]
    return spark.createDataFrame(rows, "id long, x array<double>, y double").cache()


def test_perceptron_beats_the_mean_and_is_the_same_however_it_is_dealt(curved):
    from tessera.operators import perceptron

    out = []
    for parts in (1, 16):
        data = curved.repartition(parts, "id").sortWithinPartitions("id").cache()
        model = perceptron.fit(data, "x", "y", hidden=(16, 8), steps=25)
        assert all(b <= a for a, b in zip(model.losses, model.losses[1:], strict=False))
        out.append({r.id: (r.y, r.p) for r in data.select("id", "y", model.predict(F.col("x")).alias("p")).collect()})
    assert out[0].pop(900)[1] is None and out[1].pop(900)[1] is None and out[0].pop(901)[1] is not None and out[1].pop(901)
    y, one, many = (np.array(v) for v in ([out[0][i][0] for i in range(400)], [out[0][i][1] for i in range(400)], [out[1][i][1] for i in range(400)]))
    assert ((y - one) ** 2).mean() < 0.2 * y.var()
    assert np.abs(one - many).max() < 1e-3


def test_perceptron_gradient_is_that_of_the_loss():
    from tessera.operators.perceptron import loss_gradient

    rng = np.random.default_rng(1)
    x, y, sizes = rng.normal(size=(20, 3)), rng.normal(size=20), (3, 4, 2, 1)
    w = rng.normal(size=3 * 4 + 4 + 4 * 2 + 2 + 2 + 1)
    exact = loss_gradient(x, y, w, sizes)
    for k in range(len(w)):
        e = np.zeros(len(w))
        e[k] = 1e-6
        slope = (loss_gradient(x, y, w + e, sizes)[-2] - loss_gradient(x, y, w - e, sizes)[-2]) / 2e-6
        assert abs(slope - exact[k]) < 1e-5
    assert exact[-1] == 20
