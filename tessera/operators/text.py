"""Review-text operators: review rollups, token statistics, hash split,
TF-IDF and an exact multinomial naive Bayes, all as DataFrame plans.

Scale notes
-----------
* Tokenising is a per-row JVM expression; texts are processed whole.
* Token counts explode tokens inside the row and aggregate with a map-side
  partial step, so a very frequent token (a third of all tokens) costs one
  partial row per map task, not a hot reducer.
* TF-IDF: documents are dealt over partitions of ``TASK_BYTES`` of text, so
  a task's (doc, term) counts stay the same size however large the input is
  -> document frequency per word, then per pair of words that can still be
  among the ``max_terms`` most frequent terms (a pair is no more frequent
  than either word) -> vocabulary = distributed top-k (``orderBy().limit(k)``,
  planned as TakeOrderedAndProject).  The vocabulary has a proven size bound
  (``max_terms``) and is broadcast; the per-document L2 norm is a window
  over one document's vocabulary terms (<= max_terms rows).
* The split is a per-row md5 threshold: no sort, no shuffle, stable across
  re-runs and re-planning (unlike ``randomSplit`` on a re-computed input).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import materialize

HASH_DIGITS = 8  # hex digits of md5 used for the split threshold
#: Bytes of text to a partition whose terms are counted by document.
TASK_BYTES = 4 << 20
#: Words that are sent to every task to choose the pairs that are counted.
SENT_WORDS = 1_000_000


# ------------------------------------------------------------- preparation
def with_tokens(reviews: DataFrame, text: str = "review_text") -> DataFrame:
    return reviews.withColumn("tokens", T.tokens(text))


def with_sentiment(reviews: DataFrame, prefer_text: bool = False) -> DataFrame:
    """F11-F13 on a reviews frame that already has ``tokens``."""
    cols = T.derive_sentiment(F.col("rating"), F.col("tokens"), prefer_text)
    return reviews.withColumns(cols)


# ------------------------------------------------------------- A11-A14
def category_crosstab(df: DataFrame, row: str = "category", col: str = "sentiment",
                      values=T.LABELS) -> DataFrame:
    """Count per (row, col) in wide form, 0-filled, fixed column list."""
    out = df.groupBy(row).pivot(col, list(values)).count().na.fill(0)
    return out.select(row, *[F.col(v).cast("bigint").alias(v) for v in values])


def value_share(df: DataFrame, col: str = "sentiment") -> DataFrame:
    """Count and share of each value."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per value
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), total))


def rating_histogram(df: DataFrame, spark, col: str = "rating", lo: int = 1, hi: int = 5) -> DataFrame:
    """Count per rating on the fixed domain lo..hi (0-filled; values
    outside the domain are dropped)."""
    counts = df.where(F.col(col).between(lo, hi)).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    domain = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias(col))
    return (domain.join(F.broadcast(counts), col, "left")  # <= hi-lo+1 rows
                  .select(col, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def sentiment_kpis(df: DataFrame, col: str = "sentiment") -> DataFrame:
    """Total, positive/negative counts and percentages, mean rating."""
    n = F.count(F.lit(1))
    pos = F.count_if(F.col(col) == "Positive")
    neg = F.count_if(F.col(col) == "Negative")
    return df.agg(n.alias("total"), pos.alias("n_positive"), neg.alias("n_negative"),
                  F.try_divide(pos * 100.0, n).alias("pct_positive"),
                  F.try_divide(neg * 100.0, n).alias("pct_negative"),
                  F.avg("rating").alias("mean_rating"))


# ------------------------------------------------------------- P6
def search_any(df: DataFrame, query: str, columns=None) -> DataFrame:
    """Keep rows where any cell's text contains ``query`` (case-insensitive).

    Cells are cast to text and joined with a separator that cannot occur in
    a lower-cased query match across cells; an empty query keeps all rows.
    """
    q = (query or "").strip().lower()
    if not q:
        return df
    cols = columns or df.columns
    hay = F.lower(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in cols]))
    return df.where(hay.contains(q))


# ------------------------------------------------------------- A18 / W7
def token_counts(df: DataFrame, toks: str = "tokens", group=()) -> DataFrame:
    """Occurrences of each token (optionally per group)."""
    return (df.select(*group, F.explode(toks).alias("token"))
              .groupBy(*group, "token").agg(F.count(F.lit(1)).alias("n")))


def top_tokens(df: DataFrame, by: str = "sentiment", k: int = 10, toks: str = "tokens") -> DataFrame:
    """K most frequent tokens per class, ties broken by token.

    ``row_number() <= k`` is planned as a WindowGroupLimit, which also runs
    before the shuffle, so each class ships at most k rows per partition.
    """
    counts = token_counts(df, toks, group=(by,))
    w = Window.partitionBy(by).orderBy(F.desc("n"), F.asc("token"))
    return (counts.withColumn("rank", F.row_number().over(w))
                  .where(F.col("rank") <= k))


# ------------------------------------------------------------- M2 / M3
def hash_threshold(fraction: float) -> str:
    return format(int(fraction * 16 ** HASH_DIGITS), f"0{HASH_DIGITS}x")


def hash_split(df: DataFrame, id_col: str, test_fraction: float = 0.2, flag: str = "is_test") -> DataFrame:
    """M2/M3: deterministic split by md5(id) < threshold.

    Independent of the label, so every class is split at the same expected
    rate (stratified in expectation) without sorting any class.
    """
    h = F.substring(F.md5(F.col(id_col).cast("string")), 1, HASH_DIGITS)
    return df.withColumn(flag, h < F.lit(hash_threshold(test_fraction)))


def exact_stratified_split(df: DataFrame, id_col: str, label: str, test_fraction: float = 0.2,
                           flag: str = "is_test") -> DataFrame:
    """M2 exact form: per label, the ceil(f*n) rows with the smallest md5(id).

    No class is sorted as a whole: counts by the hash's first digits tell in
    which range of hashes each class's last test row lies, and only that range
    is ranked (a 65,536th of the class).
    """
    h = F.md5(F.col(id_col).cast("string"))
    ranged = df.withColumn("_h", h).withColumn("_range", F.substring("_h", 1, 4))
    counts = ranged.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.ceil(F.sum("_n").over(Window.partitionBy(label)) * test_fraction)
    limits = counts.select(F.col(label).alias("_label"), F.col("_range").alias("_of"), (wanted - before).alias("_left"), "_n")
    joined = ranged.join(limits, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_of")))
    edge = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("_label", "_of").orderBy("_h", id_col))
    inner = joined.where(~edge).withColumn(flag, F.col("_left") > 0)
    outer = joined.where(edge).withColumn(flag, rank <= F.col("_left"))
    return inner.unionByName(outer).select(*df.columns, flag)


# ------------------------------------------------------------- M10 TF-IDF
def dealt_by_document(docs: DataFrame, size, *doc: str) -> DataFrame:
    """``docs`` hash-partitioned by their id into partitions of about TASK_BYTES of ``size``,
    whatever number of shuffle partitions the session has."""
    total = docs.agg(F.sum(size)).first()[0] or 0
    return docs.repartition(-(-total // TASK_BYTES) or 1, *doc)


def term_frequencies(docs: DataFrame, doc: str = "doc_id", toks: str = "tokens",
                     text: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, *keep, term, tf) over unigrams and bigrams of each document.

    Documents are hash-partitioned by id *before* the explode: the shuffle
    then moves documents (corpus bytes), not exploded terms (about twice
    the corpus plus a row header per term), the (doc, term) aggregation
    needs no further exchange, and tokenising runs on every partition even
    when the input arrives in few splits.  The partitions grow in number with
    the texts' bytes (one more read of the texts), not in size.  Ids are
    unique, so no partition can be hot.
    """
    if text is not None:  # tokenise after the repartition
        dealt = dealt_by_document(docs.select(doc, text, *keep), F.octet_length(text), doc).select(doc, *keep, T.tokens(text).alias(toks))
    else:
        dealt = dealt_by_document(docs.select(doc, toks, *keep), F.octet_length(F.array_join(toks, " ")), doc)
    return (dealt.select(doc, *keep, F.explode(T.uni_bi_grams(F.col(toks))).alias("term"))
                 .groupBy(doc, *keep, "term").agg(F.count(F.lit(1)).alias("tf")))


def fit_vocabulary(tf: DataFrame, n_docs, max_terms: int = 2500, min_df: int = 2,
                   doc: str = "doc_id") -> DataFrame:
    """Vocabulary (term, idf, df, cf): terms with df >= min_df, the
    ``max_terms`` most frequent by corpus count (ties by term), smooth idf
    ln((1+N)/(1+df)) + 1.

    A pair of words is no more frequent than either word.  So when the words
    alone fill the vocabulary, a pair can enter it only if both its words are
    as frequent as the last of them; moreover its first word, which comes
    before the pair, is then one of them.  All other pairs, most of a corpus'
    different terms, need not be counted.  ``tf`` is read twice.
    """
    def stats(rows: DataFrame) -> DataFrame:
        return (rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
                    .where(F.col("df") >= min_df))

    def most_frequent(rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc("cf"), F.asc("term")).limit(max_terms)

    is_pair = F.instr("term", " ") > 0
    words = materialize(stats(tf.where(~is_pair)))
    leading = materialize(most_frequent(words))
    n, least = leading.agg(F.count(F.lit(1)), F.min("cf")).first()
    frequent = words.where(F.col("cf") >= least) if n == max_terms else words
    pairs = tf.where(is_pair)
    if n:
        pairs = _with_word(pairs, 1, leading)  # <= max_terms rows
        if frequent.count() <= SENT_WORDS:
            pairs = _with_word(pairs, -1, frequent)
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return most_frequent(words.unionByName(stats(pairs))).select("term", idf.alias("idf"), "df", "cf")


def _with_word(pairs: DataFrame, at: int, words: DataFrame) -> DataFrame:
    """Rows whose term's first (1) or last (-1) word is one of ``words``; the planner
    tests them before it counts them by document."""
    return pairs.join(F.broadcast(words.select(F.col("term").alias("word"))),
                      F.substring_index("term", " ", at) == F.col("word"), "left_semi")


def tfidf(tf: DataFrame, vocab: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, term, weight and what ``tf`` carries): tf * idf over the vocabulary, L2-normalised per doc."""
    vocab = F.broadcast(vocab.select("term", "idf"))  # <= max_terms rows
    # the semi join goes below the counts of ``tf``: terms outside the vocabulary are not counted
    j = tf.join(vocab, "term", "left_semi").join(vocab, "term")
    raw = F.col("tf") * F.col("idf")
    w = Window.partitionBy(doc)
    norm = F.sqrt(F.sum(raw * raw).over(w))
    return j.select(*[c for c in tf.columns if c != "tf"], (raw / norm).alias("weight"))


# ------------------------------------------------------------- M12 NB
def fit_naive_bayes(weights: DataFrame, labels: DataFrame, n_classes: int = 3,
                    alpha: float = 0.5, doc: str = "doc_id", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Multinomial NB on tf-idf weights with their label (exact, in SQL aggregates).

    ``labels`` has one row per training document.  Returns (term -> log P(term|class) per class as columns ``flp_c``,
    one row of log priors ``lp_c``).  Smoothing alpha is added to every vocabulary term;
    the class sizes come from the labelled training documents.
    """
    per_class = weights.groupBy("term").pivot(label, list(range(n_classes))).agg(F.sum("weight")).na.fill(0.0)
    # per_class has one row per vocabulary term (<= max_terms): a global
    # window over it is bounded by the vocabulary size.
    everything = Window.partitionBy()
    n_terms = F.count(F.lit(1)).over(everything)
    flp = per_class.select("term", *[
        F.log((F.col(str(c)) + alpha) /
              (F.sum(F.col(str(c))).over(everything) + F.lit(alpha) * n_terms)).alias(f"flp_{c}")
        for c in range(n_classes)])
    size = F.count(F.lit(1)).cast("double")
    priors = labels.agg(*[F.when(F.count_if(F.col(label) == c) > 0, F.log(F.count_if(F.col(label) == c) / size)).alias(f"lp_{c}")
                          for c in range(n_classes)])
    return flp, priors


def predict_naive_bayes(weights: DataFrame, docs: DataFrame, flp: DataFrame, priors: DataFrame,
                        n_classes: int = 3, doc: str = "doc_id", label: str = "label") -> DataFrame:
    """Argmax_c log_prior_c + sum_t w(d,t) * flp_c(t); ties -> lowest class.

    ``flp`` has one row per vocabulary term (bounded) and is broadcast; docs
    without any vocabulary term score by their priors alone.
    """
    sums = (weights.join(F.broadcast(flp), "term")
                   .groupBy(doc).agg(*[F.sum(F.col("weight") * F.col(f"flp_{c}")).alias(f"s_{c}")
                                       for c in range(n_classes)]))
    row = priors.select(F.struct(*priors.columns)).scalar()
    prior = {c: row[f"lp_{c}"] for c in range(n_classes)}
    scored = docs.join(sums, doc, "left").select(
        "*", *[(F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) + F.coalesce(prior[c], F.lit(float("-inf"))))
               .alias(f"score_{c}") for c in range(n_classes)])
    best = F.lit(0)
    best_score = F.col("score_0")
    for c in range(1, n_classes):
        better = F.col(f"score_{c}") > best_score
        best = F.when(better, F.lit(c)).otherwise(best)
        best_score = F.greatest(best_score, F.col(f"score_{c}"))
    return scored.withColumn("prediction", best.cast("int")).drop(
        *[f"s_{c}" for c in range(n_classes)])
