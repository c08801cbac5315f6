"""Review-sentiment classification on Spark ML (M10 ML form, M11-M13, M16-M17).

tokens (JVM regex) -> unigrams + bigrams -> vocabulary of 2,500 terms with
df >= 2 and smooth idf ln((1+N)/(1+df)) + 1, fitted on the train part in
SQL aggregates -> CountVectorizerModel over that vocabulary -> idf scaling ->
L2 normaliser -> three classifiers -> accuracy and confusion matrix.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import forest as forest_rows
from tessera.operators import metrics
from tessera.operators import text as X
from tessera.session import TREE_AGGREGATION_MB, for_fitting, side_by_side, tracked
from tessera.sources.contracts import min_rows

MAX_TERMS, MIN_DF = 2500, 2
LR_MAX_ITER, LR_C, NB_ALPHA, RF_TREES, RF_MAX_DEPTH = 500, 1.0, 0.5, 100, 30
SEED = 42
MODEL_ORDER = ("Logistic Regression", "Naive Bayes", "Random Forest")
MIN_ROWS = 30  # fewer reviews after the filters: refuse to train (P7)
#: Training rows from which the forest is grown by ``operators.forest``, as so many smaller
#: ones side by side; Spark's learner passes over all rows again for every few nodes.
SPLIT_ROWS, FORESTS = 5_000, 12
#: Tasks that the fits running at the same time may have together.
TASKS_AT_ONCE = 12


def require_classes(labelled: DataFrame, label: str = "label", minimum: int = 2) -> None:
    """Training needs at least two classes; fail before any fit."""
    n = labelled.select(F.count_distinct(label)).first()[0]
    if n < minimum:
        raise ValueError(f"need >= {minimum} sentiment classes to train, found {n}")


def tfidf_vectors(split: DataFrame):
    """(frame with ``features``, vocabulary list) — fitted on the train part.

    The vocabulary and smooth idf come from the same SQL fit as the
    registered TF-IDF queries (``operators.text.fit_vocabulary``: df >= 2,
    the 2,500 most frequent terms, ties by term); its <= 2,500 rows are the
    model's vocabulary, so no CountVectorizer / IDF fitting passes run.
    """
    # tokens computed once for the passes below; as one text they take a tenth of the terms' memory
    dealt = X.dealt_by_document(split.select("doc_id", "label", "is_test", "review_text"), F.octet_length("review_text"), "doc_id")
    clean = tracked(dealt.select("doc_id", "label", "is_test", T.clean_text("review_text").alias("clean")).persist())
    tokens = F.filter(F.split("clean", " "), lambda t: t != "")
    terms = clean.select("doc_id", "label", "is_test", T.uni_bi_grams(tokens).alias("terms"))
    train = terms.where(~F.col("is_test"))
    tf = (train.select("doc_id", F.explode("terms").alias("term"))
               .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")))
    n_train = train.select(F.count(F.lit(1))).scalar()
    vocab = (X.fit_vocabulary(tf, n_train, MAX_TERMS, MIN_DF)
              .orderBy(F.desc("cf"), F.asc("term")).collect())  # bounded: MAX_TERMS rows
    words = [r["term"] for r in vocab]
    cv = CountVectorizerModel.from_vocabulary(words, inputCol="terms", outputCol="tf")
    smooth = DenseVector([r["idf"] for r in vocab])  # ln((1+N)/(1+df)) + 1
    weighted = ElementwiseProduct(scalingVec=smooth, inputCol="tf",
                                  outputCol="raw").transform(cv.transform(terms))
    vec = Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(weighted)
    return vec, words


def classifiers(n_train: int):
    """sklearn's C-penalised multinomial LR == Spark's regParam = 1/(C n)."""
    return {
        "Logistic Regression": LogisticRegression(maxIter=LR_MAX_ITER, regParam=1.0 / (LR_C * n_train),
                                                  elasticNetParam=0.0, standardization=False,
                                                  family="multinomial"),
        "Naive Bayes": NaiveBayes(smoothing=NB_ALPHA, modelType="multinomial"),
        "Random Forest": forest(RF_TREES, SEED, TREE_AGGREGATION_MB),
    }


def forest(trees: int, seed: int, memory_mb: int) -> RandomForestClassifier:
    # maxMemoryInMB decides which nodes draw their features together: fixed
    return RandomForestClassifier(numTrees=trees, maxDepth=RF_MAX_DEPTH,
                                  featureSubsetStrategy="sqrt", seed=seed,
                                  cacheNodeIds=True, maxMemoryInMB=memory_mb,
                                  checkpointInterval=10)


def forests(n_train: int) -> list[RandomForestClassifier]:
    """The forest's trees as one estimator or, over many rows, as FORESTS with a seed each,
    which share its trees and its memory.  How many depends on the rows alone."""
    n = FORESTS if n_train > SPLIT_ROWS else 1
    return [forest(RF_TREES * (k + 1) // n - RF_TREES * k // n, SEED + k, TREE_AGGREGATION_MB // n) for k in range(n)]


def voted(models, data: DataFrame) -> DataFrame:
    """``data`` with the prediction of all trees: the class with the largest sum of their
    votes (ties: the lowest class), as in one forest of them."""
    out = data
    for k, model in enumerate(models):
        out = model.setRawPredictionCol(f"votes_{k}").setProbabilityCol("").setPredictionCol("").transform(out)
    votes = vector_to_array("votes_0")
    for k in range(1, len(models)):
        votes = F.zip_with(votes, vector_to_array(f"votes_{k}"), lambda x, y: x + y)
    return (out.withColumn("votes", votes).withColumn("prediction", F.array_position("votes", F.array_max("votes")) - 1)
               .select(*data.columns, "prediction"))


def grown_and_voted(estimators, data: DataFrame, n_train: int) -> DataFrame:
    """The test rows of ``data`` with the prediction of all trees of the forests that
    ``estimators`` describe, grown over its other rows; votes count as in ``voted``."""
    first = estimators[0]
    shares = forest_rows.class_shares(data, [(est.getSeed(), est.getNumTrees()) for est in estimators], n_train,
                                      len(T.LABELS), first.getMaxDepth())
    votes = F.array(*[f"s_{c}" for c in range(len(T.LABELS))])
    voted_for = (F.array_position(votes, F.array_max(votes)) - 1).cast("double")
    return data.where(F.col("is_test")).join(shares.select("id", voted_for.alias("prediction")), "id")


def fit_and_score(reviews: DataFrame):
    """reviews (doc_id, tokens, sentiment) -> long prediction table
    (model, doc_id, label, prediction) over the test part."""
    labelled = min_rows(reviews, MIN_ROWS).withColumn("label", T.label_code("sentiment"))
    require_classes(labelled)
    split = X.hash_split(labelled, "doc_id")
    vec, _ = tfidf_vectors(split)
    data = for_fitting(vec.select("doc_id", "features", F.col("label").cast("double").alias("label"), "is_test"), "doc_id")
    data = data.withColumn("id", F.monotonically_increasing_id())
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    n_train = train.count()
    grown = forests(n_train)
    estimators = classifiers(n_train)
    if len(grown) > 1:
        del estimators["Random Forest"]
    models = side_by_side({name: lambda est=est: est.fit(train) for name, est in estimators.items()},
                          at_once=max(2, TASKS_AT_ONCE // train.rdd.getNumPartitions()))
    out = None
    for name in MODEL_ORDER:
        p = models[name].transform(test) if name in models else grown_and_voted(grown, data, n_train)
        p = p.select(F.lit(name).alias("model"), "doc_id",
                     F.col("label").cast("int").alias("label"),
                     F.col("prediction").cast("int").alias("prediction"))
        out = p if out is None else out.unionByName(p)
    return out


def comparison(preds: DataFrame) -> DataFrame:
    """M16 + S6: accuracy per model, best flagged (ties: model order)."""
    acc = metrics.accuracy(preds, group=["model"])
    order = F.array_position(F.array(*[F.lit(x) for x in MODEL_ORDER]), F.col("model"))
    return metrics.flag_best(acc.withColumn("model_order", order), "accuracy",
                             lower_is_better=False, order_col="model_order").drop("model_order")


def confusion(preds: DataFrame, model: str) -> DataFrame:
    """M17 for one model: rows = actual label code, columns = predicted."""
    return metrics.confusion_matrix(preds.where(F.col("model") == model), [0, 1, 2])
