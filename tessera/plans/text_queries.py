"""Registered review-text queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import metrics
from tessera.operators import text as X
from tessera.session import fitting_scope, materialize, tracked
from tessera.sources import views
from tessera.sources.views_sql import with_views

R = 6
SEARCH_QUERY = "recommend"
TEST_FRACTION = 0.2
MAX_TERMS, MIN_DF, NB_ALPHA = 2500, 2, 0.5


def _round(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), R) + F.lit(0.0) for c in cols})


def scored_reviews(spark, sf_dir) -> DataFrame:
    """reviews view + tokens + derived sentiment (the frame every text query
    starts from); lazy, so queries that need only the rating never read the
    text."""
    return X.with_sentiment(X.with_tokens(views.reviews(spark, sf_dir)))


def labelled_split(spark, sf_dir) -> DataFrame:
    r = scored_reviews(spark, sf_dir).withColumn("label", T.label_code("sentiment"))
    return X.hash_split(r, "doc_id", TEST_FRACTION)


def tfidf_vocabulary(spark, sf_dir):
    """((doc, term, tf) rows with label and is_test, vocabulary fitted on the train part).

    The term rows are lazy: the vocabulary reads the texts once and is stored
    (<= MAX_TERMS rows), the weights read them once more; nothing of the
    corpus' size is written.
    """
    s = labelled_split(spark, sf_dir)
    tf = X.term_frequencies(s, text="review_text", keep=("label", "is_test"))
    n_train = s.where(~F.col("is_test")).select(F.count(F.lit(1))).scalar()  # reads the ids only
    return tf, materialize(X.fit_vocabulary(tf.where(~F.col("is_test")), n_train, MAX_TERMS, MIN_DF))


def nb_predictions(spark, sf_dir) -> DataFrame:
    """The weights feed the fit (train rows) and the prediction (test rows), so
    they are cached, with spill, while the predictions are stored."""
    with fitting_scope():
        tf, vocab = tfidf_vocabulary(spark, sf_dir)
        w = tracked(X.tfidf(tf, vocab).persist())
        docs = labelled_split(spark, sf_dir).select("doc_id", "label", "is_test")
        train, test = docs.where(~F.col("is_test")), docs.where(F.col("is_test"))
        flp, priors = X.fit_naive_bayes(w.where(~F.col("is_test")), train.select("label"), alpha=NB_ALPHA)
        out = X.predict_naive_bayes(w.where(F.col("is_test")), test.select("doc_id", "label"), flp, priors)
        return materialize(out.select("doc_id", "label", "prediction"))


# ------------------------------------------------------------------ queries
def q_review_clean_text(spark, sf_dir):
    r = views.reviews(spark, sf_dir)
    return r.select("doc_id", T.clean_text("review_text").alias("clean_text"))


def q_review_sentiment(spark, sf_dir):
    r = scored_reviews(spark, sf_dir)
    out = r.select("doc_id", "sentiment", "confidence", *[
        v.alias(k) for k, v in T.text_sentiment(F.col("tokens")).items()])
    return _round(out, ["confidence", "text_confidence"])


def q_category_sentiment_crosstab(spark, sf_dir):
    return X.category_crosstab(scored_reviews(spark, sf_dir))


def q_sentiment_share(spark, sf_dir):
    return _round(X.value_share(scored_reviews(spark, sf_dir)), ["share"])


def q_rating_histogram(spark, sf_dir):
    return X.rating_histogram(views.reviews(spark, sf_dir), spark)


def q_sentiment_kpis(spark, sf_dir):
    return _round(X.sentiment_kpis(scored_reviews(spark, sf_dir)),
                  ["pct_positive", "pct_negative", "mean_rating"])


def q_token_counts(spark, sf_dir):
    return X.token_counts(X.with_tokens(views.reviews(spark, sf_dir)))


def q_top_keywords_by_sentiment(spark, sf_dir):
    return X.top_tokens(scored_reviews(spark, sf_dir), "sentiment", 10)


def q_review_search(spark, sf_dir):
    r = views.reviews(spark, sf_dir)
    return X.search_any(r, SEARCH_QUERY).select("doc_id", "category", "rating", "helpful_votes")


def q_review_preview(spark, sf_dir):
    r = scored_reviews(spark, sf_dir)
    return r.select("doc_id", T.preview("review_text").alias("preview"),
                    T.stars("rating").alias("stars"), T.rating_band("rating").alias("band"),
                    T.percent_text("confidence").alias("confidence_text"))


def q_review_split(spark, sf_dir):
    return labelled_split(spark, sf_dir).select("doc_id", "label", "is_test")


def q_tfidf_weights(spark, sf_dir):
    tf, vocab = tfidf_vocabulary(spark, sf_dir)
    return _round(X.tfidf(tf, vocab).select("doc_id", "term", "weight"), ["weight"])


def q_tfidf_vocabulary(spark, sf_dir):
    return _round(tfidf_vocabulary(spark, sf_dir)[1], ["idf"])


def q_nb_predictions(spark, sf_dir):
    return nb_predictions(spark, sf_dir)


def q_nb_accuracy(spark, sf_dir):
    return metrics.accuracy(nb_predictions(spark, sf_dir))


def q_nb_confusion(spark, sf_dir):
    return metrics.confusion_matrix(nb_predictions(spark, sf_dir), [0, 1, 2])


QUERIES = {
    "review_clean_text": q_review_clean_text,
    "review_sentiment": q_review_sentiment,
    "category_sentiment_crosstab": q_category_sentiment_crosstab,
    "sentiment_share": q_sentiment_share,
    "rating_histogram": q_rating_histogram,
    "sentiment_kpis": q_sentiment_kpis,
    "token_counts": q_token_counts,
    "top_keywords_by_sentiment": q_top_keywords_by_sentiment,
    "review_search": q_review_search,
    "review_preview": q_review_preview,
    "review_split": q_review_split,
    "tfidf_vocabulary": q_tfidf_vocabulary,
    "tfidf_weights": q_tfidf_weights,
    "nb_predictions": q_nb_predictions,
    "nb_accuracy": q_nb_accuracy,
    "nb_confusion": q_nb_confusion,
}


# ------------------------------------------------------------------ oracles
def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


STOP_SQL, POS_SQL, NEG_SQL = _list(T.STOPWORDS), _list(T.POSITIVE_WORDS), _list(T.NEGATIVE_WORDS)
TOKENS_SQL = (f"coalesce(list_filter(regexp_extract_all(lower(review_text), '[a-z]+'), "
              f"lambda x: length(x) >= 3 AND NOT list_contains({STOP_SQL}, x)), []::VARCHAR[])")

SCORED_SQL = f"""
SELECT *,
  CASE WHEN rating IS NULL OR isnan(rating) THEN 'Neutral' WHEN rating >= 4 THEN 'Positive'
       WHEN rating <= 2 THEN 'Negative' ELSE 'Neutral' END AS sentiment,
  CASE WHEN rating IS NULL OR isnan(rating) THEN 0.55E0
       WHEN rating >= 4 THEN least(0.96E0, 0.62E0 + (rating - 4) * 0.17E0)
       WHEN rating <= 2 THEN least(0.96E0, 0.62E0 + (3 - rating) * 0.17E0) ELSE 0.55E0 END AS confidence
FROM (SELECT *, {TOKENS_SQL} AS tokens FROM reviews)
"""

HITS_SQL = f"""
SELECT *, CASE WHEN p > n THEN 'Positive' WHEN n > p THEN 'Negative' ELSE 'Neutral' END AS text_sentiment,
  CASE WHEN p > n THEN least(0.95E0, 0.55E0 + p / CAST(greatest(p + n, 1) AS DOUBLE) * 0.40E0)
       WHEN n > p THEN least(0.95E0, 0.55E0 + n / CAST(greatest(p + n, 1) AS DOUBLE) * 0.40E0)
       ELSE 0.50E0 END AS text_confidence
FROM (SELECT *, CAST(len(list_intersect(list_distinct(tokens), {POS_SQL})) AS INTEGER) AS p,
             CAST(len(list_intersect(list_distinct(tokens), {NEG_SQL})) AS INTEGER) AS n FROM scored)
"""

THRESH = "33333333"  # a fifth of the 32-bit range, in hex
SPLIT_SQL = f"""
SELECT *, CASE sentiment WHEN 'Negative' THEN 0 WHEN 'Neutral' THEN 1 WHEN 'Positive' THEN 2 END AS label,
       substring(md5(CAST(doc_id AS VARCHAR)), 1, 8) < '{THRESH}' AS is_test FROM scored
"""

TF_SQL = """
SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest(list_concat(tokens,
      CASE WHEN len(tokens) < 2 THEN []::VARCHAR[]
           ELSE list_transform(list_slice(tokens, 1, len(tokens) - 1), lambda x, i: x || ' ' || tokens[i + 1]) END)) AS term
  FROM split) GROUP BY doc_id, term
"""

VOCAB_SQL = f"""
SELECT term, ln((1.0E0 + n) / (1.0E0 + df)) + 1.0E0 AS idf, df, cf FROM (
  SELECT term, count(*) AS df, sum(tf) AS cf FROM tf WHERE doc_id IN (SELECT doc_id FROM split WHERE NOT is_test)
  GROUP BY term HAVING count(*) >= {MIN_DF} ORDER BY cf DESC, term LIMIT {MAX_TERMS}),
  (SELECT count(*) AS n FROM split WHERE NOT is_test)
"""

WEIGHTS_SQL = """
SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS weight
FROM tf JOIN vocab USING (term)
"""

NB_SQL = f"""
WITH train AS (SELECT doc_id, label FROM split WHERE NOT is_test),
test AS (SELECT doc_id, label FROM split WHERE is_test),
fc AS (SELECT term,
              coalesce(sum(CASE WHEN label = 0 THEN weight END), 0.0E0) AS c0,
              coalesce(sum(CASE WHEN label = 1 THEN weight END), 0.0E0) AS c1,
              coalesce(sum(CASE WHEN label = 2 THEN weight END), 0.0E0) AS c2
       FROM weights JOIN train USING (doc_id) GROUP BY term),
flp AS (SELECT term, ln((c0 + {NB_ALPHA}) / (sum(c0) OVER () + {NB_ALPHA} * count(*) OVER ())) AS f0,
               ln((c1 + {NB_ALPHA}) / (sum(c1) OVER () + {NB_ALPHA} * count(*) OVER ())) AS f1,
               ln((c2 + {NB_ALPHA}) / (sum(c2) OVER () + {NB_ALPHA} * count(*) OVER ())) AS f2 FROM fc),
pri AS (SELECT label, ln(count(*) / CAST((SELECT count(*) FROM train) AS DOUBLE)) AS lp FROM train GROUP BY label),
sums AS (SELECT doc_id, sum(weight * f0) AS s0, sum(weight * f1) AS s1, sum(weight * f2) AS s2
         FROM weights JOIN test USING (doc_id) JOIN flp USING (term) GROUP BY doc_id),
sc AS (SELECT t.doc_id, t.label,
              coalesce(s0, 0.0E0) + coalesce((SELECT lp FROM pri WHERE label = 0), -'inf'::DOUBLE) AS sc0,
              coalesce(s1, 0.0E0) + coalesce((SELECT lp FROM pri WHERE label = 1), -'inf'::DOUBLE) AS sc1,
              coalesce(s2, 0.0E0) + coalesce((SELECT lp FROM pri WHERE label = 2), -'inf'::DOUBLE) AS sc2
       FROM test t LEFT JOIN sums USING (doc_id))
SELECT doc_id, label,
       CAST(CASE WHEN sc2 > greatest(sc0, sc1) THEN 2 WHEN sc1 > sc0 THEN 1 ELSE 0 END AS INTEGER) AS prediction
FROM sc
"""

_BASE = {"scored": SCORED_SQL}
_SPLIT = {"scored": SCORED_SQL, "split": SPLIT_SQL}
_TFIDF = dict(_SPLIT, tf=TF_SQL, vocab=VOCAB_SQL, weights=WEIGHTS_SQL)
_NB = dict(_TFIDF, nb=NB_SQL)


def _r(cols):
    return ", ".join(f"round({c}, {R}) + 0.0E0 AS {c}" for c in cols)


ORACLES = {
    "review_clean_text": with_views(
        f"SELECT doc_id, array_to_string({TOKENS_SQL}, ' ') AS clean_text FROM reviews", "reviews"),
    "review_sentiment": with_views(
        f"SELECT doc_id, sentiment, {_r(['confidence', 'text_confidence'])}, text_sentiment, "
        "p AS pos_hits, n AS neg_hits FROM hits", "reviews", extra=dict(_BASE, hits=HITS_SQL)),
    "category_sentiment_crosstab": with_views("""
SELECT category, count(*) FILTER (WHERE sentiment = 'Negative') AS Negative,
       count(*) FILTER (WHERE sentiment = 'Neutral') AS Neutral,
       count(*) FILTER (WHERE sentiment = 'Positive') AS Positive
FROM scored GROUP BY category""", "reviews", extra=_BASE),
    "sentiment_share": with_views(f"""
SELECT sentiment, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM scored) AS DOUBLE), {R}) + 0.0E0 AS share
FROM scored GROUP BY sentiment""", "reviews", extra=_BASE),
    "rating_histogram": with_views("""
SELECT CAST(d.r AS INTEGER) AS rating, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM range(1, 6) d(r) LEFT JOIN (SELECT rating, count(*) AS n FROM reviews WHERE rating BETWEEN 1 AND 5 GROUP BY rating) c
ON c.rating = d.r""", "reviews"),
    "sentiment_kpis": with_views(f"""
SELECT count(*) AS total, count(*) FILTER (WHERE sentiment = 'Positive') AS n_positive,
       count(*) FILTER (WHERE sentiment = 'Negative') AS n_negative,
       round(count(*) FILTER (WHERE sentiment = 'Positive') * 100.0E0 / count(*), {R}) + 0.0E0 AS pct_positive,
       round(count(*) FILTER (WHERE sentiment = 'Negative') * 100.0E0 / count(*), {R}) + 0.0E0 AS pct_negative,
       round(avg(rating), {R}) + 0.0E0 AS mean_rating FROM scored""", "reviews", extra=_BASE),
    "token_counts": with_views(
        f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS_SQL}) AS token FROM reviews) GROUP BY token",
        "reviews"),
    "top_keywords_by_sentiment": with_views("""
SELECT sentiment, token, n, rank FROM (
  SELECT sentiment, token, n, CAST(row_number() OVER (PARTITION BY sentiment ORDER BY n DESC, token) AS INTEGER) AS rank
  FROM (SELECT sentiment, token, count(*) AS n FROM (SELECT sentiment, unnest(tokens) AS token FROM scored)
        GROUP BY sentiment, token)) WHERE rank <= 10""", "reviews", extra=_BASE),
    "review_search": with_views(f"""
SELECT doc_id, category, rating, helpful_votes FROM reviews
WHERE contains(lower(concat_ws(chr(1), CAST(doc_id AS VARCHAR), review_text, CAST(rating AS VARCHAR), category,
                                CAST(helpful_votes AS VARCHAR))), '{SEARCH_QUERY}')""", "reviews"),
    "review_preview": with_views("""
SELECT doc_id, CASE WHEN length(review_text) > 80 THEN substring(review_text, 1, 80) || '…' ELSE review_text END AS preview,
       '★' || CAST(rating AS VARCHAR) AS stars,
       CASE WHEN rating <= 2 THEN 'low' WHEN rating = 3 THEN 'mid' WHEN rating >= 4 THEN 'high' END AS band,
       CAST(CAST(round_even(confidence * 100.0E0, 0) AS BIGINT) AS VARCHAR) || '%' AS confidence_text
FROM scored""", "reviews", extra=_BASE),
    "review_split": with_views("SELECT doc_id, label, is_test FROM split", "reviews", extra=_SPLIT),
    "tfidf_vocabulary": with_views(f"SELECT term, {_r(['idf'])}, df, cf FROM vocab", "reviews", extra=_TFIDF),
    "tfidf_weights": with_views(f"SELECT doc_id, term, {_r(['weight'])} FROM weights", "reviews", extra=_TFIDF),
    "nb_predictions": with_views("SELECT * FROM nb", "reviews", extra=_NB),
    "nb_accuracy": with_views("""
SELECT round_even(avg(CAST(label = prediction AS DOUBLE)) * 100.0E0, 2) AS accuracy, count(*) AS n FROM nb""",
        "reviews", extra=_NB),
    "nb_confusion": with_views("""
SELECT label, count(*) FILTER (WHERE prediction = 0) AS pred_0, count(*) FILTER (WHERE prediction = 1) AS pred_1,
       count(*) FILTER (WHERE prediction = 2) AS pred_2 FROM nb GROUP BY label""", "reviews", extra=_NB),
}
