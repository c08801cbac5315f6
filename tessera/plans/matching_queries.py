"""Registered queries that match tables of points and of predicted ranks with
the entities (J3, R5, R6, W8), and least squares on the forecast features (M6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import clip_at_zero
from tessera.operators import entities as E
from tessera.operators import least_squares, matching, panel
from tessera.plans import entity_queries, panel_queries
from tessera.session import materialize
from tessera.sources.tables import read_table
from tessera.sources.views_sql import with_views

R, K = 6, 5
#: Predictions differ in their last digits with the order of sums.
SHOWN = 3
FEATURES = tuple(c for c in panel.FEATURE_COLS)


def query_points(spark, sf_dir) -> DataFrame:
    """One point of scores a customer; some lack a score."""
    key = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select(
        key.alias("point_id"), (F.lit(50.0) + key * 3 % 41 + key % 8 / F.lit(8.0)).alias("overall_score"), (F.lit(50.0) + key * 5 % 51).alias("research_score"),
        F.when(key % 19 != 0, F.lit(50.0) + key * 11 % 51).alias("teaching_score"), (F.lit(50.0) + key * 7 % 51).alias("hec_score"),
        F.when(key % 23 != 0, (key * 13 % 800) / F.lit(10.0)).alias("predicted_rank"))


def q_nearest_entities_batch(spark, sf_dir):
    profile = materialize(entity_queries.profile(spark, sf_dir))
    out = matching.nearest_entities(profile, query_points(spark, sf_dir), k=K)
    return entity_queries._round(out, ["hec_rank", "distance"])


def q_closest_rank_batch(spark, sf_dir):
    profile = materialize(entity_queries.profile(spark, sf_dir))
    out = matching.closest_ranks(profile, query_points(spark, sf_dir), k=K, id_col="point_id")
    return entity_queries._round(out, ["hec_rank", "rank_diff"])


def q_forecast_ols(spark, sf_dir):
    """M6 with J2: least squares on the months before the hold-out, its predictions (F8) beside the held-out rows."""
    split = panel.temporal_split(panel_queries.features(spark, sf_dir), 6)
    fitted = materialize(least_squares.coefficients(split.where(~F.col("is_test")), list(FEATURES), "sales_qty"))
    guess = clip_at_zero(least_squares.predicted(split, fitted, list(FEATURES)))
    return split.where("is_test").select("date", "store", "product", F.col("sales_qty").cast("double").alias("actual"),
                                         (F.round(guess, SHOWN) + F.lit(0.0)).alias("predicted"))


QUERIES = {
    "nearest_entities_batch": q_nearest_entities_batch,
    "closest_rank_batch": q_closest_rank_batch,
    "forecast_ols": q_forecast_ols,
}

_POINTS = """
SELECT c_custkey AS point_id, 50.0E0 + c_custkey * 3 % 41 + (c_custkey % 8) / 8.0E0 AS overall_score, 50.0E0 + c_custkey * 5 % 51 AS research_score,
       CASE WHEN c_custkey % 19 <> 0 THEN 50.0E0 + c_custkey * 11 % 51 END AS teaching_score, 50.0E0 + c_custkey * 7 % 51 AS hec_score,
       CASE WHEN c_custkey % 23 <> 0 THEN (c_custkey * 13 % 800) / 10.0E0 END AS predicted_rank
FROM customer"""
_BOTH = dict(entity_queries._P, points=_POINTS)
_STATS = ", ".join(f"avg({f}) AS {f}_mean, stddev_pop({f}) AS {f}_std" for f in E.FEATURES)


def _apart(f: str) -> str:
    std = f"CASE WHEN s.{f}_std = 0 THEN 1.0E0 ELSE s.{f}_std END"
    return f"power((p.{f} - s.{f}_mean) / {std} - (q.{f} - s.{f}_mean) / {std}, 2)"


_P = len(FEATURES)
_NAMES = [*FEATURES, "sales_qty"]
_SPREAD = [f"CASE WHEN stddev_pop({c}) > {least_squares.LEAST_SPREAD} * abs(avg({c})) THEN stddev_pop({c}) ELSE 1.0E0 END" for c in _NAMES]
_ROWS = ", ".join("[" + ", ".join(f"covar_pop({a}, {b}) / (s[{i + 1}] * s[{j + 1}])" for j, b in enumerate(_NAMES)) + "]" for i, a in enumerate(FEATURES))
_OLS = dict(
    panel_queries._FEAT,
    split="SELECT *, date > (SELECT max(date) - INTERVAL 6 MONTH FROM features) AS is_test FROM features",
    train=f"SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in _NAMES)} FROM split WHERE NOT is_test",
    spread=f"SELECT [{', '.join(_SPREAD)}] AS s FROM train",
    moments=f"SELECT any_value(s) AS s, [{', '.join(f'avg({c})' for c in _NAMES)}] AS m, [{_ROWS}] AS rows FROM train, spread GROUP BY s",
    elim=f"""
SELECT 1 AS k, rows FROM moments
UNION ALL
SELECT k + 1, CASE WHEN rows[k][k] > {least_squares.LEAST_REST}
    THEN list_transform(rows, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / rows[k][k])
                                           ELSE list_transform(range(1, {_P + 2}), lambda j: r[j] - r[k] * (rows[k][j] / rows[k][k])) END)
    ELSE list_transform(rows, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: 0.0E0) ELSE r END) END
FROM elim WHERE k <= {_P}""",
    weights=f"SELECT list_transform(range(1, {_P + 1}), lambda i: rows[i][{_P + 1}] * s[{_P + 1}] / s[i]) AS w, m FROM elim, moments_only WHERE k = {_P + 1}",
)
_OLS = {k: v for name, sql in _OLS.items() for k, v in ([("moments_only", "SELECT s, m FROM moments"), (name, sql)] if name == "weights" else [(name, sql)])}
_GUESS = f"m[{_P + 1}]" + "".join(f" + w[{i + 1}] * ({c}::DOUBLE - m[{i + 1}])" for i, c in enumerate(FEATURES))

ORACLES = {
    "nearest_entities_batch": with_views(f"""
SELECT point_id, CAST(rank AS INTEGER) AS rank, entity, round(hec_rank, {R}) + 0.0E0 AS hec_rank, round(distance, {R}) + 0.0E0 AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(distance, {matching.DIGITS}), entity) AS rank FROM (
    SELECT q.point_id, p.entity, p.hec_rank, sqrt({' + '.join(_apart(f) for f in E.FEATURES)}) AS distance
    FROM points q, profile p, (SELECT {_STATS} FROM profile) s) WHERE distance IS NOT NULL)
WHERE rank <= {K}""", "entities_raw", extra=_BOTH),
    "closest_rank_batch": with_views(f"""
SELECT point_id, CAST(place AS INTEGER) AS place, entity, round(hec_rank, {R}) + 0.0E0 AS hec_rank, round(rank_diff, {R}) + 0.0E0 AS rank_diff,
       CASE WHEN rank_diff = 0 THEN 'perfect' WHEN rank_diff <= 3 THEN 'excellent' WHEN rank_diff <= 5 THEN 'good' ELSE 'error' END AS verdict FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(rank_diff, {matching.DIGITS}), entity) AS place FROM (
    SELECT q.point_id, p.entity, p.hec_rank, abs(p.hec_rank - q.predicted_rank) AS rank_diff FROM points q, profile p) WHERE rank_diff IS NOT NULL)
WHERE place <= {K}""", "entities_raw", extra=_BOTH),
    "forecast_ols": with_views(f"""
SELECT date, store, product, sales_qty::DOUBLE AS actual, round(greatest({_GUESS}, 0.0E0), {SHOWN}) + 0.0E0 AS predicted
FROM split, weights WHERE is_test""", "sales", extra=_OLS).replace("WITH ", "WITH RECURSIVE ", 1),
}
