"""Forests over sparse rows: trees equal a plain loop's, however their rows are dealt."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tessera.operators import forest as R
from tessera.plans import ml_queries, sentiment
from tests.conftest import SF_SMALL

WIDE = 130  # more than two words of bits


def _dense(n, seed, wide=WIDE):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, wide)) < 0.15, rng.random((n, wide)), 0.0)
    x[0] = 0
    label = ((x[:, 0] > 0) + (x[:, 1] > 0.4)).astype(np.int64)
    flip = rng.random(n) < 0.2
    label[flip] = rng.integers(0, 3, flip.sum())
    return x, label, rng.random(n) < 0.3


def _rows(x):
    row, feature = np.nonzero(x)
    bounds = R.thresholds(feature, x[row, feature], x.shape[1])
    bins = R.binned(feature, x[row, feature], bounds)
    matrix = np.zeros(x.shape, np.int64)
    matrix[row, feature] = bins
    cut, words = len(x) // 3, -(-x.shape[1] // 64) * 64
    blocks = [(len(x[s]), R.packed((row[k] - s.start) * words + feature[k]), bins[k].tobytes())
              for s in (slice(0, cut), slice(cut, len(x))) for k in [(row >= s.start) & (row < s.stop)]]
    return R.Rows(x.shape[1], blocks), matrix


def _plain(matrix, label, weight, scored, seed, tree, max_depth):
    """The same tree, node by node."""
    out = np.zeros((len(matrix), 3), np.int64)

    def gini(w):
        return (w * w).sum() / w.sum() if w.sum() else 0

    def node(rows, number, depth):
        own = np.array([weight[rows][(label[rows] == c) & ~scored[rows]].sum() for c in range(3)], float)
        best = (gini(own) * (1 + 1e-12), None)
        if depth < max_depth and (own > 0).sum() > 1:
            for f in R.drawn_features(seed, tree, np.array([number]), matrix.shape[1])[0]:
                for b in range(R.BINS - 1, 0, -1):
                    right = matrix[rows, f] >= b
                    w = np.array([weight[rows][right & (label[rows] == c) & ~scored[rows]].sum() for c in range(3)], float)
                    if w.sum() and w.sum() < own.sum() and gini(w) + gini(own - w) > best[0]:
                        best = (gini(w) + gini(own - w), (f, b))
        if best[1] is None:
            out[rows[scored[rows]]] = np.rint(own / max(own.sum(), 1) * R.SHARE)
            return
        right = matrix[rows, best[1][0]] >= best[1][1]
        node(rows[~right], 2 * number, depth + 1)
        node(rows[right], 2 * number + 1, depth + 1)

    node(np.flatnonzero((weight > 0) | scored), 1, 0)
    return out


@pytest.mark.parametrize("max_depth", [0, 3, 30])
def test_tree_equals_a_plain_loop(max_depth, monkeypatch):
    monkeypatch.setattr(R, "STEP_ROWS", 17)
    x, label, scored = _dense(150, 1)
    rows, matrix = _rows(x)
    assert (rows.bin(np.repeat(np.arange(150), WIDE), np.tile(np.arange(WIDE), 150)).reshape(x.shape) == matrix).all()
    for tree in range(2):
        weight = R.weights(7, tree, np.arange(150)).astype(np.int64)
        found = R.grown(rows, label, weight, scored, 7, tree, 1, WIDE, 3, max_depth)
        assert (found == _plain(matrix, label, weight, scored, 7, tree, max_depth)).all()
        assert (np.abs(found[scored].sum(axis=1) - R.SHARE) <= 3).all() and not found[~scored].any()


def test_draws():
    w = R.weights(1, 2, np.arange(200_000))
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    for wide in (1, 2, 3, 10, 100, 2500):
        f = R.drawn_features(3, 4, np.arange(1, 4001), wide)
        assert f.shape == (4000, int(np.ceil(np.sqrt(wide)))) and f.min() >= 0 and f.max() < wide
        assert all(len(set(x)) == len(x) for x in f.tolist())
        n = np.bincount(f.ravel(), minlength=wide)
        assert abs(n - f.size / wide).max() < 6 * np.sqrt(f.size / wide) + 1
    gaps = np.array([0, 1, 254, 255, 256, 509, 510, 511, 1500, 70_000])
    assert (R.unpacked(R.packed(gaps)) == gaps).all()


@pytest.fixture(scope="module")
def data(spark):
    x, label, scored = _dense(600, 2)
    kind = StructType([StructField("id", LongType()), StructField("label", LongType()), StructField("is_test", BooleanType()), StructField("features", VectorUDT())])
    vector = lambda i, v: Vectors.dense(v) if i % 5 == 0 else Vectors.sparse(WIDE, np.flatnonzero(v), v[v > 0])
    rows = [(i, int(label[i]), bool(scored[i]), vector(i, x[i])) for i in range(600)]
    return spark.createDataFrame(rows, kind).repartition(3, "id").cache(), label, scored


def test_forest_is_the_same_where_no_task_may_hold_all_rows(data, monkeypatch):
    """Before: each pass over all rows split as many nodes as fit a fixed memory, so passes grew with the rows."""
    frame, label, scored = data
    monkeypatch.setattr(R, "BLOCK_ROWS", 90)
    found = {}
    for limit, forests in ((R.LOCAL_BYTES, [(5, 3), (9, 2)]), (20_000, [(5, 3), (9, 2)]), (1, [(5, 3), (9, 2)])):
        monkeypatch.setattr(R, "LOCAL_BYTES", limit)
        out = R.class_shares(frame, forests, int((~scored).sum()), 3, 12).collect()
        found[limit] = {r.id: (r.s_0, r.s_1, r.s_2) for r in out}
    whole, some, none = found.values()
    assert whole == some == none and set(whole) == set(np.flatnonzero(scored).tolist())
    right = np.mean([np.argmax(v) == label[i] for i, v in whole.items()])
    assert right > max(np.bincount(label[scored])) / scored.sum()


def test_large_forests_are_not_fitted_by_passes_over_all_rows(spark, monkeypatch):
    """Every test review gets a class from each model; Spark's learner takes no part in the large forest."""
    for name, value in (("SPLIT_ROWS", 10), ("RF_TREES", 14), ("LR_MAX_ITER", 3)):
        monkeypatch.setattr(sentiment, name, value)
    monkeypatch.setattr(sentiment.RandomForestClassifier, "fit", lambda *_: pytest.fail("a pass for every few nodes"))
    compared = {r.model: r for r in ml_queries.q_sentiment_model_comparison(spark, SF_SMALL).collect()}
    cells = ml_queries.q_sentiment_model_confusion(spark, SF_SMALL).groupBy("model").agg(F.sum(F.expr("pred_0 + pred_1 + pred_2")).alias("n")).collect()
    assert set(compared) == set(sentiment.MODEL_ORDER) and {r.n for r in cells} == {r.n for r in compared.values()}
