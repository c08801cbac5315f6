"""Registered model-fitting queries (Spark ML; iterative -> rows-only check).

tests/test_models.py fits small estimators of the same kinds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.numeric import forecast_band, residual
from tessera.operators import panel
from tessera.session import fitting_scope, materialize
from tessera.sources import contracts, sinks
from tessera.plans import entity_queries, forecast, panel_queries, ranking, sentiment, text_queries

R = 6


def _round(df, cols):
    return df.withColumns({c: F.round(F.col(c), R) + F.lit(0.0) for c in cols})


# Every query fits the models that it reads, and no others: nothing is kept from query to query.


# ------------------------------------------------------------------ forecast
def _forecast(spark, sf_dir, wanted=forecast.MODEL_ORDER) -> dict:
    """The monthly rollup, and the held-out predictions and importances of the ``wanted`` models."""
    with fitting_scope():
        monthly = panel_queries.monthly(spark, sf_dir)
        preds, models, cols = forecast.fit_and_score(panel.series_features(monthly), wanted=wanted)
        forest = models.get("Random Forest")
        return {"monthly": monthly, "preds": materialize(preds),
                "importance": forecast.feature_importance(spark, forest, cols) if forest else None}


def _best_predictions(flow):
    """Predictions of the model with the smallest MAPE."""
    preds = flow["preds"]
    best = forecast.comparison(preds).where("best_mape").select("model").scalar()
    return preds.where(F.col("model") == best)


def q_forecast_model_comparison(spark, sf_dir):
    return _round(forecast.comparison(_forecast(spark, sf_dir)["preds"]), ["mse", "r2"])


def q_forecast_feature_importance(spark, sf_dir):
    return _round(_forecast(spark, sf_dir, ("Random Forest",))["importance"], ["importance"])


def q_forecast_actual_vs_predicted(spark, sf_dir):
    """A8, F19, F20 on the best model: actual, predicted, band and residual by month."""
    out = panel.actual_vs_predicted(_best_predictions(_forecast(spark, sf_dir)), actual="actual", predicted="predicted")
    out = out.withColumns(forecast_band(F.col("predicted"))).withColumns(residual(F.col("actual"), F.col("predicted")))
    return _round(out, ["actual", "predicted", "lower", "upper", "residual"])


def q_forecast_top_product(spark, sf_dir):
    """The top product's months, with its forecast and band over the held-out ones."""
    flow = _forecast(spark, sf_dir)
    monthly = flow["monthly"]
    history = panel.top_key_history(monthly, "product")
    top = panel.top_key(monthly, "product")
    ahead = panel.actual_vs_predicted(_best_predictions(flow).where(F.col("product") == top), actual="actual", predicted="predicted")
    ahead = ahead.select("date", "predicted").withColumns(forecast_band(F.col("predicted")))
    return _round(history.join(ahead, "date", "left"), ["predicted", "lower", "upper"])


def q_forecast_summary(spark, sf_dir):
    """IO7: the run's summary as one JSON text."""
    flow = _forecast(spark, sf_dir)
    compared = _round(forecast.comparison(flow["preds"]), ["mse", "r2"])
    best = compared.where("best_mape").select("model").scalar()
    frame = sinks.summary_frame(flow["monthly"], compared, best, predictions=_best_predictions(flow))
    return frame.select(F.to_json(F.struct(*frame.columns)).alias("summary"))


def q_forecast_export(spark, sf_dir):
    """IO8 + IO1: the best model's predictions written as CSV and read again."""
    from tessera.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forecast-export-{uuid.uuid4().hex}"
    sinks.export_predictions(_best_predictions(_forecast(spark, sf_dir)), path)
    return contracts.read_csv(spark, path, "date date, store string, product string, model string, actual double, predicted double")


# ----------------------------------------------------------------- sentiment
def _sentiment(spark, sf_dir) -> dict:
    with fitting_scope():
        return {"preds": materialize(sentiment.fit_and_score(text_queries.scored_reviews(spark, sf_dir)))}


def q_sentiment_model_comparison(spark, sf_dir):
    return sentiment.comparison(_sentiment(spark, sf_dir)["preds"])


def q_sentiment_model_confusion(spark, sf_dir):
    """M17 for each fitted classifier, 0-filled."""
    preds = _sentiment(spark, sf_dir)["preds"]
    cells = preds.groupBy("model", "label").pivot("prediction", [0, 1, 2]).count().na.fill(0)
    return cells.select("model", "label", *[F.col(str(v)).cast("bigint").alias(f"pred_{v}") for v in (0, 1, 2)])


# ------------------------------------------------------------------- ranking
def _ranking(spark, sf_dir, report, columns):
    """A report on the scaled profile, rounded and stored before the fitting frames go."""
    with fitting_scope():
        profile = materialize(entity_queries.profile(spark, sf_dir))
        return materialize(_round(report(ranking.fitting_frame(profile), profile), columns))


def q_rank_model_comparison(spark, sf_dir):
    return _ranking(spark, sf_dir, lambda data, _: ranking.evaluate(data), ["mae", "mse", "r2"])


def q_rank_simulation(spark, sf_dir):
    return _ranking(spark, sf_dir, lambda data, _: ranking.simulate(ranking.fit_models(data), data), ["hec_rank"])


def q_rank_feature_importance(spark, sf_dir):
    return _ranking(spark, sf_dir, lambda data, _: ranking.feature_importance(data), ["importance"])


def q_rank_closest_entities(spark, sf_dir):
    """R5 on the best model's rank for the simulator's default scores."""
    return _ranking(spark, sf_dir, lambda data, profile: ranking.closest(data, profile, entity_queries.QUERY_POINT),
                    ["predicted_rank", "hec_rank", "rank_diff"])


QUERIES = {
    "forecast_model_comparison": q_forecast_model_comparison,
    "forecast_feature_importance": q_forecast_feature_importance,
    "forecast_actual_vs_predicted": q_forecast_actual_vs_predicted,
    "forecast_top_product": q_forecast_top_product,
    "forecast_summary": q_forecast_summary,
    "forecast_export": q_forecast_export,
    "sentiment_model_comparison": q_sentiment_model_comparison,
    "sentiment_model_confusion": q_sentiment_model_confusion,
    "rank_model_comparison": q_rank_model_comparison,
    "rank_simulation": q_rank_simulation,
    "rank_feature_importance": q_rank_feature_importance,
    "rank_closest_entities": q_rank_closest_entities,
}
ORACLES: dict[str, str] = {}
