"""Term counts that stay the same size by task, and forests grown side by side."""

import random
from collections import Counter

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import text as X
from tessera.plans import sentiment


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words[:rng.choice((6, 60))]) for _ in range(rng.randrange(30)))) for i in range(80)]
    docs += [(7, "waa wab waa wab"), (100, None), (101, "")]
    return docs, spark.createDataFrame(docs, "doc_id long, review_text string").cache()


def _counts(docs):
    by_doc = {}
    for i, text in docs:
        words = [w for w in (text or "").split() if w not in ("was", "who")]
        by_doc.setdefault(i, Counter()).update(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
    return by_doc


def test_partitions_grow_with_the_texts_not_in_size(texts, monkeypatch):
    docs, frame = texts
    monkeypatch.setattr(X, "TASK_BYTES", 100)
    tf = X.term_frequencies(frame, text="review_text")
    total = sum(len(t) for _, t in docs if t)
    assert tf.rdd.getNumPartitions() == -(-total // 100) > 8
    rows = {(r.doc_id, r.term): r.tf for r in tf.collect()}
    assert rows == {(i, t): n for i, c in _counts(docs).items() for t, n in c.items()}
    assert X.term_frequencies(frame.where("review_text is null"), text="review_text").count() == 0


@pytest.mark.parametrize("max_terms", [1, 7, 40, 75, 5000])
@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_vocabulary_equals_a_plain_count(texts, monkeypatch, max_terms, sent):
    docs, frame = texts
    monkeypatch.setattr(X, "SENT_WORDS", sent)
    df, cf = Counter(), Counter()
    for c in _counts(docs).values():
        df.update(c.keys())
        cf.update(c)
    wanted = sorted((t for t in cf if df[t] >= 2), key=lambda t: (-cf[t], t))[:max_terms]
    found = X.fit_vocabulary(X.term_frequencies(frame, text="review_text"), len(docs), max_terms, 2)
    assert {r.term: (r.df, r.cf) for r in found.collect()} == {t: (df[t], cf[t]) for t in wanted}
    # pairs are chosen by their words before they are counted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [term") < plan.rindex("LeftSemi")


def test_vocabulary_of_nothing(spark):
    tf = X.term_frequencies(spark.createDataFrame([(1, None), (2, "")], "doc_id long, review_text string"), text="review_text")
    assert X.fit_vocabulary(tf, 2).count() == 0


def test_weights_count_no_term_outside_the_vocabulary(texts):
    _, frame = texts
    tf = X.term_frequencies(frame, text="review_text")
    vocab = X.fit_vocabulary(tf, 80, 5, 2)
    weights = X.tfidf(tf, vocab)
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [doc_id") < plan.index("LeftSemi")
    squares = weights.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert squares and all(abs(r.s - 1) < 1e-9 for r in squares)


def test_forests_share_the_trees_and_vote_as_one(spark):
    one, many = sentiment.forests(sentiment.SPLIT_ROWS), sentiment.forests(sentiment.SPLIT_ROWS + 1)
    assert len(one) == 1 and one[0].getNumTrees() == sentiment.RF_TREES and one[0].getSeed() == sentiment.SEED
    assert len(many) > 1 and sum(f.getNumTrees() for f in many) == sentiment.RF_TREES and len({f.getSeed() for f in many}) == len(many)
    rng = random.Random(1)
    data = spark.createDataFrame([(i, Vectors.dense(rng.random(), rng.random()), float(rng.randrange(3))) for i in range(60)], ["id", "features", "label"]).coalesce(1).cache()
    models = [RandomForestClassifier(numTrees=3, maxDepth=4, seed=k).fit(data) for k in range(2)]
    single = models[0].transform(data).select("id", "prediction").collect()
    assert sorted(single) == sorted(sentiment.voted(models[:1], data).select("id", F.col("prediction").cast("double")).collect())
    votes = [{r.id: r.v for r in RandomForestClassifier(numTrees=3, maxDepth=4, seed=k).fit(data).transform(data).select("id", vector_to_array("rawPrediction").alias("v")).collect()} for k in range(2)]
    for r in sentiment.voted(models, data).collect():
        total = [a + b for a, b in zip(votes[0][r.id], votes[1][r.id], strict=True)]
        assert r.prediction == total.index(max(total))


def test_flow_with_split_forests_scores_every_test_doc(spark, monkeypatch):
    for name, value in (("SPLIT_ROWS", 10), ("FORESTS", 3), ("RF_TREES", 4), ("RF_MAX_DEPTH", 4), ("LR_MAX_ITER", 5)):
        monkeypatch.setattr(sentiment, name, value)
    rng = random.Random(2)
    reviews = spark.createDataFrame([(i, " ".join(rng.choice(("good", "bad", "lamp", "desk")) for _ in range(8)), ("Negative", "Neutral", "Positive")[i % 3]) for i in range(90)],
                                    "doc_id long, review_text string, sentiment string")
    n_test = X.hash_split(reviews, "doc_id").where("is_test").count()
    counts = {r.model: r["count"] for r in sentiment.fit_and_score(reviews).where("prediction between 0 and 2").groupBy("model").count().collect()}
    assert counts == dict.fromkeys(sentiment.MODEL_ORDER, n_test)
