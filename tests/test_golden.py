"""Golden micro-inputs (FIXTURES.md D) and edge cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import entities as E
from tessera.operators import metrics, panel
from tessera.operators import text as X
from tessera.operators import vectors as VO

# Published actual/predicted pairs of the reference dashboard (test part).
PAIRS = [(566, 462), (1223, 950), (749, 930), (745, 883), (694, 709), (879, 870), (943, 957),
         (602, 624), (647, 729), (1014, 987), (879, 806), (1162, 863), (889, 1013), (406, 543),
         (566, 510), (306, 334), (991, 1069), (572, 543), (896, 933), (763, 651), (836, 796),
         (351, 300), (1205, 965), (804, 914), (789, 818), (557, 594), (1071, 1012), (806, 827),
         (724, 776), (568, 541)]
# Published first three monthly totals.
TOTALS = [32702, 28824, 41796]


def test_rating_ladder(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (3.0,), (4.0,), (5.0,), (None,), (float("nan"),)],
                               "r double")
    rs = T.rating_sentiment(F.col("r"))
    got = [(r[0], round(r[1], 2)) for r in df.select(rs["sentiment"], rs["confidence"]).collect()]
    assert got == [("Negative", 0.96), ("Negative", 0.79), ("Neutral", 0.55), ("Neutral", 0.55),
                   ("Positive", 0.62), ("Positive", 0.79), ("Neutral", 0.55), ("Neutral", 0.55)]


def test_lexicon_tie_is_neutral(spark):
    df = spark.createDataFrame([("Not bad but not great either",)], "t string")
    ts = T.text_sentiment(T.tokens(F.col("t")))
    r = df.select(ts["text_sentiment"], ts["text_confidence"], ts["pos_hits"], ts["neg_hits"]).first()
    assert tuple(r) == ("Neutral", 0.5, 1, 1)


def test_lexicon_counts_distinct_tokens(spark):
    df = spark.createDataFrame([("great great great bad",)], "t string")
    ts = T.text_sentiment(T.tokens(F.col("t")))
    r = df.select(ts["text_sentiment"], ts["text_confidence"]).first()
    assert r[0] == "Neutral"


def test_clean_text(spark):
    df = spark.createDataFrame([("It's GREAT, works-well 100% café",), (None,)], "t string")
    got = [r[0] for r in df.select(T.clean_text("t")).collect()]
    assert got == ["great works well caf", ""]


def test_gram_schmidt_2d_and_3d(spark):
    rows = [(1, 1, [3.0, 1.0]), (1, 2, [2.0, 2.0]),
            (2, 1, [1.0, 1.0, 0.0]), (2, 2, [1.0, 0.0, 1.0]), (2, 3, [0.0, 1.0, 1.0])]
    vs = spark.createDataFrame(rows, "grp int, ord long, vec array<double>")
    got = {(r.grp, r.ord): r.u for r in VO.gram_schmidt(vs).collect()}
    assert np.allclose(got[(1, 2)], [-0.4, 1.2])
    assert np.allclose(got[(2, 2)], [0.5, -0.5, 1.0])
    assert np.allclose(got[(2, 3)], [-2 / 3, 2 / 3, 2 / 3])


def test_gram_schmidt_dependent_and_zero_vectors_are_null(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [2.0, 0.0]), (1, 3, [0.0, 0.0]), (1, 4, [0.0, 5.0]),
            (1, 5, [3.0, 3.0])]
    vs = spark.createDataFrame(rows, "grp int, ord long, vec array<double>")
    got = {r.ord: r.u for r in VO.gram_schmidt(vs).collect()}
    assert got[2] is None and got[3] is None and got[5] is None
    assert np.allclose(got[4], [0.0, 5.0])


def test_gram_schmidt_matches_numpy_classical(spark):
    rng = np.random.default_rng(7)
    rows = [(g, i, rng.normal(size=5).tolist()) for g in range(3) for i in range(4)]
    vs = spark.createDataFrame(rows, "grp int, ord long, vec array<double>")
    got = {(r.grp, r.ord): r.u for r in VO.gram_schmidt(vs).collect()}
    for g in range(3):
        us = []
        for i in range(4):
            v = np.array(rows[g * 4 + i][2])
            u = v.copy()
            for b in us:
                u = u - b * (v @ b / (b @ b))
            us.append(u)
            assert np.allclose(got[(g, i)], u)


def test_projection_of_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 0.0])], "v array<double>, u array<double>")
    assert df.select(V.projection("v", "u")).first()[0] is None


def test_holdout_cutoff(spark):
    dates = [dt.date(2023, m, 1) for m in range(1, 13)]
    df = spark.createDataFrame([(d,) for d in dates], "date date")
    got = [r.date.month for r in panel.temporal_split(df, 6).where("is_test").collect()]
    assert sorted(got) == [7, 8, 9, 10, 11, 12]


def test_rolling_current_row_rounded(spark):
    df = spark.createDataFrame([(dt.date(2020, i + 1, 1), "s", "p", v) for i, v in enumerate(TOTALS)],
                               "date date, store string, product string, sales_qty long")
    got = [r.rolling_3m_int for r in panel.total_by_date(df).orderBy("date").collect()]
    assert got == [None, None, 34441]


def test_rolling_guard_on_short_series(spark):
    rows = [(dt.date(2020, m, 1), "s", "p", q, 0, 1.0) for m, q in zip(range(1, 5), [10, 20, 30, 40])]
    df = spark.createDataFrame(rows, "date date, store string, product string, sales_qty long, "
                                     "promotion int, avg_price double")
    f = panel.series_features(df, drop_incomplete=False, encode=False).orderBy("date").collect()
    assert [r.rolling_3m_mean for r in f] == [None, None, None, 20.0]
    assert [r.lag_1m for r in f] == [None, 10, 20, 30]
    assert [r.trend_idx for r in f] == [0, 1, 2, 3]
    assert f[3].rolling_3m_std == pytest.approx(10.0)


def test_metrics_on_published_pairs(spark):
    df = spark.createDataFrame([(float(a), float(p)) for a, p in PAIRS], "actual double, predicted double")
    m = metrics.regression_metrics(df).first()
    y = np.array([a for a, _ in PAIRS], float)
    p = np.array([b for _, b in PAIRS], float)
    assert m.mae == pytest.approx(np.mean(np.abs(y - p)))
    assert m.rmse == pytest.approx(math.sqrt(np.mean((y - p) ** 2)))
    assert m.mape == pytest.approx(np.mean(np.abs((y - p) / (y + 1e-9))) * 100)
    r2 = 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2)
    assert m.r2 == pytest.approx(r2)


def test_tied_mode_takes_smallest(spark):
    raw = spark.createDataFrame([("e", "b", 1), ("e", "a", 2), ("e", "b", 3), ("e", "a", 4)],
                                "entity string, department string, overall_score int")
    p = E.entity_profile(raw).first()
    assert p.department == "a" and p.overall_score == 2.5


def test_keyword_class_keeps_substring_rule(spark):
    df = spark.createDataFrame([("International Institute",), ("City College",)], "n string")
    got = [r[0] for r in df.select(T.keyword_class(F.col("n"), E.PUBLIC_KEYWORDS)).collect()]
    assert got == ["Public", "Private"]


def test_crosstab_fills_empty_class(spark):
    df = spark.createDataFrame([("A", "Positive"), ("B", "Negative")], "category string, sentiment string")
    rows = {r.category: tuple(r)[1:] for r in X.category_crosstab(df).collect()}
    assert rows == {"A": (0, 0, 1), "B": (1, 0, 0)}


def test_monthly_rollup_drops_null_keys_and_zero_sums(spark):
    rows = [(dt.date(2020, 1, 5), "s", "p", None, 0, 10.0), (dt.date(2020, 1, 9), None, "p", 5, 1, 10.0)]
    df = spark.createDataFrame(rows, "date date, store string, product string, sales_qty int, "
                                     "promotion int, price double")
    out = panel.monthly_rollup(df).collect()
    assert len(out) == 1 and out[0].sales_qty == 0 and out[0].avg_price == 10.0


def test_empty_input_gives_empty_outputs(spark):
    empty = spark.createDataFrame([], "date date, store string, product string, sales_qty int, "
                                      "promotion int, price double")
    assert panel.series_features(panel.monthly_rollup(empty)).count() == 0
    k = panel.dataset_kpis(panel.monthly_rollup(empty)).first()
    assert k.n_rows == 0


def test_evenly_spaced_sample(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = [r.k for r in metrics.evenly_spaced_sample(df, ["k"], 30).orderBy("k").collect()]
    assert got == list(np.linspace(0, 99, 30, dtype=int))
    one = spark.range(1).withColumnRenamed("id", "k")
    assert [r.k for r in metrics.evenly_spaced_sample(one, ["k"], 30).collect()] == [0]


def test_gram_schmidt_orthonormal_flag(spark):
    rows = [(1, 1, [3.0, 1.0]), (1, 2, [2.0, 2.0])]
    vs = spark.createDataFrame(rows, "grp int, ord long, vec array<double>")
    got = {r.ord: r.u for r in VO.gram_schmidt(vs, orthonormal=True).collect()}
    assert np.allclose(got[1], np.array([3.0, 1.0]) / np.sqrt(10))
    assert np.allclose(got[2], np.array([-0.4, 1.2]) / np.sqrt(1.6))


def test_approx_median_option(spark):
    df = spark.range(1, 1002).withColumnRenamed("id", "q")
    exact = df.select(panel.median_of(df, "q")).first()[0]
    approx = df.select(panel.median_of(df, "q", approx_accuracy=10000)).first()[0]
    assert exact == 501.0 and abs(approx - 501) <= 1


@pytest.mark.parametrize("quantities", [[1, 2, 3, 4, None, None], [5, None, 7, 7, 9, 100, None, 2],
                                        [None, None, None]])
def test_single_pass_imputation_equals_two_pass(spark, quantities):
    rows = []
    for i, q in enumerate(quantities):
        rows.append((dt.date(2020, 1 + i % 3, 1 + i), "s" if i % 4 else None, f"p{i % 2}", q, i % 2, 10.0 + i))
    df = spark.createDataFrame(rows, "date date, store string, product string, sales_qty int, "
                                     "promotion int, price double")
    one = panel.imputed_monthly_rollup(df)
    two = panel.monthly_rollup(panel.impute_sales(df))
    key = ["date", "store", "product"]
    a = sorted(tuple(r) for r in one.select(*key, "sales_qty", "promotion", "avg_price").collect())
    b = sorted(tuple(r) for r in two.select(*key, "sales_qty", "promotion", "avg_price").collect())
    assert a == b


def test_missing_quantities_take_the_whole_median_and_prices_their_plain_mean(spark):
    rows = [(dt.date(2020, 1, 1 + i), "s", "p", q, 0, price) for i, (q, price) in enumerate(
        [(10, 1.234), (11, 1.236), (None, 0.001)])]
    df = spark.createDataFrame(rows, "date date, store string, product string, sales_qty int, promotion int, price double")
    for out in (panel.imputed_monthly_rollup(df), panel.monthly_rollup(panel.impute_sales(df))):
        row = out.first()
        assert row.sales_qty == 31.5 and abs(row.avg_price - (1.234 + 1.236 + 0.001) / 3) < 1e-12


def test_exact_stratified_split_takes_the_share_of_each_class(spark):
    from tessera.operators import text as X

    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 7 = 0 THEN NULL ELSE 'b' END AS label")
    got = {r.label: (r.n, r.t) for r in X.exact_stratified_split(df, "id", "label").groupBy("label").agg(
        F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert all(t == -(-n // 5) for n, t in got.values()) and sum(n for n, _ in got.values()) == 5000


def test_a_forest_does_not_depend_on_how_rows_arrive(spark):
    """The same rows in another order and other partitions give the same forest."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from tessera.plans.forecast import TREE_SCHEDULING
    from tessera.session import for_fitting

    df = spark.range(400).selectExpr("id", "sin(id) AS a", "cos(id * 3) AS b", "id % 11 AS c", "sin(id) * 3 + id % 11 AS label")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    trees = []
    for frame in (df.coalesce(1), df.repartition(7, "c")):
        forest = RandomForestRegressor(numTrees=5, maxDepth=6, seed=1, **TREE_SCHEDULING).fit(for_fitting(frame, "id"))
        trees.append(forest.toDebugString.split("\n", 1)[1])
    assert trees[0] == trees[1]
