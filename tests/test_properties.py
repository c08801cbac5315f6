
import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import metrics, panel
from tessera.operators import text as X
from tessera.operators import vectors as VO
from tessera.plans import panel_queries, text_queries
from tests.conftest import SF_MID, SF_SMALL


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=1000), min_size=1, max_size=20))
def test_rolling_mean_equals_direct_mean(spark, values):
    rows = [(dt.date(2000 + i // 12, i % 12 + 1, 1), "s", "p", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "date date, store string, product string, sales_qty long")
    got = [r.rolling_3m_mean for r in
           panel.series_features(df, encode=False, drop_incomplete=False).orderBy("date").collect()]
    for i, g in enumerate(got):
        if i < 3:
            assert g is None
        else:
            assert abs(g - np.mean(values[i - 3:i])) < 1e-9


def test_store_shares_sum_to_one(spark):
    shares = panel_queries.q_store_share(spark, SF_SMALL).agg(F.sum("share")).first()[0]
    assert abs(shares - 1.0) < 1e-5


def test_split_is_a_partition(spark):
    s = text_queries.labelled_split(spark, SF_MID)
    n = s.count()
    test, train = s.where("is_test").count(), s.where("NOT is_test").count()
    assert test + train == n and 0.1 < test / n < 0.3
    again = text_queries.labelled_split(spark, SF_MID).where("is_test").select("doc_id")
    assert again.exceptAll(s.where("is_test").select("doc_id")).count() == 0


def test_confusion_matrix_sums_to_n(spark):
    preds = text_queries.nb_predictions(spark, SF_MID)
    cm = metrics.confusion_matrix(preds, [0, 1, 2])
    total = cm.agg(F.sum(F.col("pred_0") + F.col("pred_1") + F.col("pred_2"))).first()[0]
    assert total == preds.count()


def test_gram_schmidt_outputs_are_orthogonal(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, rng.normal(size=6).tolist()) for g in range(4) for i in range(9)]
    vs = spark.createDataFrame(rows, "grp int, ord long, vec array<double>")
    gs = VO.gram_schmidt(vs)
    o = VO.basis_orthogonality(gs).collect()
    assert all(r.orthogonal and r.n_basis == 6 for r in o)
    # rows beyond the rank are exactly the NULL results
    assert gs.where(F.col("u").isNull()).count() == 4 * 3


def test_hash_split_rate_is_label_independent(spark):
    df = spark.range(20000).withColumn("label", (F.col("id") % 3).cast("int"))
    rates = X.hash_split(df, "id").groupBy("label").agg(F.avg(F.col("is_test").cast("double")).alias("r"))
    assert all(abs(r.r - 0.2) < 0.02 for r in rates.collect())


def test_recommendation_answers_every_request_as_all_pairs_would(spark):
    """Any GPAs, unknown and NULL preferences and departments, against every (request, entity) pair."""
    import random

    from tessera.operators import entities as E

    rng = random.Random(4)
    ents = [(f"e{i}", rng.choice("AB"), rng.randint(50, 100), rng.randint(50, 100), rng.randint(50, 100)) for i in range(300)]
    raw = spark.createDataFrame(ents + [(e[0], "C", *e[2:]) for e in ents[::7]] + [(ents[0][0], None, *ents[0][2:])],
                                "entity string, department string, overall_score int, research_score int, teaching_score int")
    prof = E.entity_profile(raw, keywords=("e1", "e2"))
    reqs = [(i, rng.choice([2 + i / 300, 3.0, None, -1.0, 0.0]), rng.choice(["Public", "Private", "Balanced", "Any", None]),
             rng.choice(["A", "B", "C", "NONE", None])) for i in range(120)]
    got = {}
    for r in E.recommend_batch(prof, raw, spark.createDataFrame(reqs, "request_id int, gpa double, preference string, department string")).collect():
        got.setdefault(r.request_id, {})[r["rank"]] = (r.entity, round(r.final_score, 9))
    offers = {(r.entity, r.department) for r in raw.collect()}
    rows = prof.collect()
    for i, gpa, pref, dep in reqs:
        def score(p, gpa=max(gpa or 0.0, 0.0), pref=pref, dep=dep):
            base = p.overall_score * gpa / 4.0 + (10.0 if dep is not None and (p.entity, dep) in offers else 0.0)
            if pref == "Public":
                return base + p.research_score + (15.0 if p.type == "Public" else 0.0)
            if pref == "Private":
                return base + p.teaching_score + (15.0 if p.type == "Private" else 0.0)
            return base + (p.research_score + p.teaching_score) / 2.0
        best = sorted(((-round(score(p), 9), p.entity) for p in rows))[:5]
        assert [got[i][k + 1] for k in range(5)] == [(e, -s) for s, e in best], (i, gpa, pref, dep)


def test_gram_schmidt_with_null_keys_copies_and_dependent_prefix(spark):
    """Every input row comes out once; equal rows, NULL keys and long dependent prefixes included."""
    from collections import Counter

    from tessera.operators import vectors as VO

    rows = [(None, 1, [1.0, 0.0, 0.0]), (None, 2, [1.0, 1.0, 0.0]), ("a", None, [0.0, 2.0, 0.0]), ("a", 1, [0.0, 4.0, 0.0]),
            ("a", 5, [3.0, 1.0, 0.0]), ("b", 1, [1.0, 0.0, 0.0]), ("b", 1, [1.0, 0.0, 0.0]), ("b", 1, [0.0, 1.0, 0.0]), ("b", 1, [0.0, 1.0, 0.0]),
            ("c", 1, None), ("c", 2, [0.0, 0.0, 0.0]), ("c", 3, [float("nan"), 0.0, 0.0]), ("c", 4, [1.0, 0.0]), ("d", 1, None)]
    rows += [("e", i, [float(i + 1), 0.0, 0.0]) for i in range(50)] + [("e", 50, [1.0, 2.0, 0.0]), ("e", 51, [1.0, 2.0, 3.0]), ("e", 52, [5.0, 2.0, 9.0])]
    out = VO.gram_schmidt(spark.createDataFrame(rows, "grp string, ord bigint, vec array<double>")).collect()
    assert Counter((r.grp, r.ord) for r in out) == Counter(r[:2] for r in rows)
    kept = sorted(((r.grp or "", -1 if r.ord is None else r.ord, [round(x, 9) for x in r.u]) for r in out if r.u is not None))
    assert [k for k in kept if k[0] != "c"] == [
        ("", 1, [1.0, 0.0, 0.0]), ("", 2, [0.0, 1.0, 0.0]), ("a", -1, [0.0, 2.0, 0.0]), ("a", 5, [3.0, 0.0, 0.0]),
        ("b", 1, [0.0, 1.0, 0.0]), ("b", 1, [1.0, 0.0, 0.0]), ("e", 0, [1.0, 0.0, 0.0]), ("e", 50, [0.0, 2.0, 0.0]), ("e", 51, [0.0, 0.0, 3.0])]
