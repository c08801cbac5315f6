"""Toxicity by class-conditional Kneser-Ney word models.

Two bigram models, one of toxic and one of ordinary text, share their backoff:

    P_c(w | u) = a_c(u, w) + l(u) * P_c(w)
    P_c(w)     = (1 - l) * max(N_c(w) - D_c, 0) / S_c + l * P(w)

``N_c(w)`` is the continuation count (in how many distinct contexts the word
follows), ``P(w)`` the continuation share over both classes together, and
``a_c`` the discounted bigram share.  The discounts are in proportion to the
class sizes and the backoff weights are common to both classes, so a rare word
or pair gives both classes the same backoff and says nothing.  Every word and
every pair with discounted evidence is in the model, whatever its words are
alone.  A word's log-likelihood ratio counts as far as its shares are likely to
differ by FACTOR between the classes, so the mix of topics and languages says
little; a pair's ratio, as far as the pair is likely to, and for the rest its
second word's score holds.  A text's score is the logistic of its ratio per
word.  Continuation counts do not grow with copies of a text, a pair counts once
per text, and equal texts are counted once.

Counts come from all labelled documents of the training fold but a fifth; on
that fifth, which the models have not seen, the two numbers of the logistic are
fitted (on a bounded sample of it).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import wordhash as W
from tessera.llm.common import columns, own_name, plain, stored

#: Discount of the smaller class; the larger one's is in proportion.
DISCOUNT = 1.0
#: A word or pair scores as far as its shares are likely to differ by this factor; so many standard errors beyond it are even odds.
FACTOR, EVEN_ERRORS = 2.0, 4.0
#: Labelled rows that the two numbers of the logistic are fitted on, at most.
FIT_ROWS = 50_000
#: Model entries that are sent to every task; a larger model is joined instead.
SENT_ENTRIES = 2_000_000
#: Labelled ids that are sent to every task; more are joined instead.
SENT_LABELS = 1_000_000
_FIRST = np.uint64(0x2545F4914F6CDD1D)  # context of a text's first word
_HIGH = np.int64(1) << np.int64(32)


def _contexts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[first[:-1][first[:-1] < len(hashes)]] = _FIRST
    return before


def _pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return W.mix(u * np.uint64(0xD6E8FEB86659FD93) + w)


def _text_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the text, first and second word of each distinct pair of a text: a text that repeats itself counts once."""
    w, first = W.word_hashes(data, offsets, W.LETTERS)
    u, doc = _contexts(w, first), np.repeat(np.arange(len(first) - 1), np.diff(first))
    once = np.unique(W.mix(_pair_key(u, w) + doc.astype(np.uint64)), return_index=True)[1]
    return doc[once], u[once], w[once]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, th, text) to (toxic, th, n): number of distinct pairs of each text."""
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for lo, hi, data, offsets in W.slices(batch.column(2)):
            n[lo:hi] = np.bincount(_text_pairs(data, offsets)[0], minlength=hi - lo)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["toxic", "th", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (u, w, n): in how many toxic and ordinary texts a word pair is, as the halves of n."""
    for batch in batches:
        toxic = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(bool)
        for lo, hi, data, offsets in W.slices(batch.column(1)):
            doc, u, w = _text_pairs(data, offsets)
            if not len(w):
                continue
            one = np.where(toxic[lo + doc], np.int64(1), _HIGH)
            _, at, back = np.unique(_pair_key(u, w), return_index=True, return_inverse=True)
            low = np.bincount(back, weights=one == 1).astype(np.int64)
            high = np.bincount(back, weights=one != 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u[at].view(np.int64)), pa.array(w[at].view(np.int64)), pa.array(low + high * _HIGH)], names=["u", "w", "n"])


class Model:
    """Sorted arrays of the entries with discounted evidence; a pair without takes its second word's score, a word without scores 0."""

    def __init__(self, words: np.ndarray, word_scores: np.ndarray, pairs: np.ndarray, pair_scores: np.ndarray):
        order = np.argsort(words)
        self.words, self.of_words = words[order], word_scores[order]
        order = np.argsort(pairs)
        self.pairs, self.of_pairs = pairs[order], pair_scores[order]

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def word_scores(self, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each word after the word before it."""
        out = np.zeros(len(w))
        for table, scores, keys in ((self.words, self.of_words, w), (self.pairs, self.of_pairs, _pair_key(_contexts(w, first), w))):
            at = self._find(table, keys)
            out[at >= 0] = scores[at[at >= 0]]
        return out


def _score(batches: Iterator[pa.RecordBatch], *, sent, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns with the text last, to all but that one and the ratio per word."""
    model = sent.value
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for lo, hi, data, offsets in W.slices(batch.column(batch.num_columns - 1)):
            w, first = W.word_hashes(data, offsets, W.LETTERS)
            sums = np.concatenate([[0.0], np.cumsum(model.word_scores(w, first))]) if len(w) else np.zeros(1)
            out[lo:hi] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=names)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) to (rid, n, u, w, times), for the joined form; at least one row a text."""
    for batch in batches:
        for lo, hi, data, offsets in W.slices(batch.column(1)):
            w, first = W.word_hashes(data, offsets, W.LETTERS)
            u = _contexts(w, first)
            doc = np.repeat(np.arange(lo, hi), np.diff(first))
            keys, times = np.unique(np.rec.fromarrays([doc, u, w], names="d,u,w"), return_counts=True)
            empty = lo + np.flatnonzero(np.diff(first) == 0)
            doc = np.concatenate([keys["d"], empty]).astype(np.int64)
            pad = np.zeros(len(empty), np.int64)
            size = np.diff(first)[doc - lo]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(size.astype(np.int64)),
                 pa.array(np.concatenate([keys["u"].view(np.int64), pad])), pa.array(np.concatenate([keys["w"].view(np.int64), pad])),
                 pa.array(np.concatenate([times.astype(np.int64), pad]))], names=["rid", "n", "u", "w", "times"])


def training_fold(doc_id) -> F.Column:
    """Documents that labels may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def calibration_part(doc_id) -> F.Column:
    """The fifth of the training fold that the logistic is fitted on."""
    return F.floor(F.crc32(doc_id.cast("string")) / 3) % 5 == 0


def _clean_labels(labels: DataFrame) -> DataFrame:
    """One row per labelled id; an id with several labels is toxic if one of them says so."""
    return labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def _discounts(toxic: float, ordinary: float) -> list[float]:
    """Discounts of both classes, in proportion to their totals."""
    least = max(1.0, min(toxic, ordinary))
    return [DISCOUNT * max(1.0, total / least) for total in (toxic, ordinary)]


def fit_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored counts: rows of kind 0 hold for a word (w) its continuation
    counts (x toxic, y ordinary) and token counts (s, t); rows of kind 1 hold
    for a frequent pair (u, w) its counts (x, y)."""
    small = F.broadcast(labels) if labels.count() <= SENT_LABELS else labels
    rows = docs.where(training_fold(F.col("doc_id")) & ~calibration_part(F.col("doc_id"))).join(small, "doc_id") \
        .select(F.col("toxic").cast("int").alias("toxic"), F.xxhash64("text").alias("th"), "text")
    # the limits are the discounts of fit_model: from the same totals, of distinct texts
    sizes = rows.mapInArrow(_sizes, "toxic int, th long, n long").groupBy("toxic", "th").agg(F.max("n").alias("n"))
    total = sizes.agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col("n"))), F.lit(0)).cast("double").alias(c) for k, c in ((1, "s"), (0, "t"))]).first()
    limits = _discounts(total["s"], total["t"])
    texts = rows.dropDuplicates(["toxic", "th"]).select("toxic", "text")
    pairs = texts.mapInArrow(_count, "u long, w long, n long").groupBy("u", "w").agg(F.sum("n").alias("n")) \
        .select("u", "w", F.col("n").bitwiseAND(F.lit((1 << 32) - 1)).alias("x"), F.shiftright("n", 32).alias("y"))
    zero = F.lit(0).cast("long")
    word = F.struct(F.lit(0).alias("kind"), zero.alias("u"), F.col("w"), (F.col("x") > 0).cast("long").alias("x"),
                    (F.col("y") > 0).cast("long").alias("y"), F.col("x").alias("s"), F.col("y").alias("t"))
    pair = F.struct(F.lit(1).alias("kind"), F.col("u"), F.col("w"), F.col("x"), F.col("y"), zero.alias("s"), zero.alias("t"))
    often = (F.col("x") > limits[0]) | (F.col("y") > limits[1])
    rows = pairs.select(F.explode(F.when(often, F.array(word, pair)).otherwise(F.array(word))).alias("r")).select("r.*")
    return stored(rows.groupBy("kind", "u", "w").agg(*[F.sum(c).alias(c) for c in "xyst"]))


def _differing(toxic: float, ordinary: float) -> F.Column:
    """How probable it is that a word or pair with counts x and y, of so many in
    all, has shares that differ by FACTOR: from its likelihood ratio against the
    nearest shares that do not, even odds at EVEN_ERRORS standard errors."""
    if not toxic or not ordinary:
        return F.lit(0.0)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    part = x / (x + y)
    near = F.least(F.greatest(part, F.lit(toxic / (toxic + FACTOR * ordinary))), F.lit(FACTOR * toxic / (FACTOR * toxic + ordinary)))
    gain = F.when(x > 0, x * F.log(part / near)).otherwise(0.0) + F.when(y > 0, y * F.log((1 - part) / (1 - near))).otherwise(0.0)
    return 1 / (1 + F.exp(F.lit(EVEN_ERRORS ** 2 / 2) - gain))


def fit_model(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model tables with the entries that hold discounted evidence: words
    (w, score) and pairs (u, w, score)."""
    words, pairs = counts.where("kind = 0"), counts.where("kind = 1")
    total = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in "xyst"], F.count("*").alias("v")).first()
    d = dict(zip("xy", _discounts(total["x"], total["y"]), strict=True))
    e = dict(zip("xy", _discounts(total["s"], total["t"]), strict=True))

    def above(c: str, limit: dict) -> F.Column:
        return F.greatest(F.col(c) - F.lit(limit[c]), F.lit(0.0))

    rest = words.agg(*[F.coalesce(F.sum(above(c, d)), F.lit(0.0)).alias(c) for c in "xy"]).first()
    mass = total["x"] + total["y"]
    back = 1.0 - (rest["x"] + rest["y"]) / mass if mass else 1.0
    back = min(max(back, 1e-6), 1.0)
    common = (F.col("x") + F.col("y") + 0.5) / F.lit(mass + 0.5 * (total["v"] + 1))
    shares = [(F.lit((1 - back) / rest[c]) * above(c, d) if rest["x"] and rest["y"] else F.lit(0.0)) + F.lit(back) * common for c in "xy"]

    surely = _differing(total["x"], total["y"])
    scored = stored(words.select("w", shares[0].alias("pt"), shares[1].alias("po"), (F.col("s") + F.col("t")).cast("double").alias("m"),
                                 ((above("x", d) > 0) | (above("y", d) > 0)).alias("evident"), surely.alias("surely"))
                    .withColumn("score", F.col("surely") * F.log(F.col("pt") / F.col("po"))))

    surely = _differing(total["s"], total["t"])
    kept = pairs.select("u", "w", surely.alias("p"), above("x", e).alias("x"), above("y", e).alias("y")).where("x > 0 or y > 0")
    heads = kept.groupBy("u").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    heads = heads.join(scored.select(F.col("w").alias("u"), "m"), "u") \
        .withColumn("weight", F.least(F.greatest(1 - (F.col("sx") + F.col("sy")) / F.col("m"), F.lit(1e-6)), F.lit(1.0)))
    # a class without evidence in a context has its share of the word there
    both = [(1 - F.col("weight")) * F.when(F.col("s" + c) > 0, F.col(c) / F.col("s" + c)).otherwise(F.col(p)) + F.col("weight") * F.col(p)
            for c, p in (("x", "pt"), ("y", "po"))]
    pair_rows = kept.join(heads, "u").join(scored.select("w", "pt", "po", "score"), "w").select(
        "u", "w", (F.col("p") * F.log(both[0] / both[1]) + (1 - F.col("p")) * F.col("score")).alias("score"))
    return stored(scored.where("evident").select("w", "score")), stored(pair_rows)


def _sent_model(word_rows: DataFrame, pair_rows: DataFrame) -> Model:
    def column(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy()

    words, pairs = word_rows.toArrow(), pair_rows.toArrow()
    return Model(column(words, "w").view(np.uint64), column(words, "score"),
                 _pair_key(column(pairs, "u").view(np.uint64), column(pairs, "w").view(np.uint64)), column(pairs, "score"))


def _joined_ratios(docs: DataFrame, name: str, word_rows: DataFrame, pair_rows: DataFrame) -> DataFrame:
    """The same ratios through joins, for a model too large to send."""
    rid = own_name(docs, "rid")
    docs = stored(docs.withColumn(rid, F.monotonically_increasing_id()))
    grams = docs.select(F.col(rid).alias("rid"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _grams, "rid long, n long, u long, w long, times long")
    found = grams.join(word_rows.withColumnRenamed("score", "of_word"), "w", "left").join(pair_rows.withColumnRenamed("score", "of_pair"), ["u", "w"], "left")
    one = F.coalesce("of_pair", "of_word", F.lit(0.0))
    sums = found.groupBy("rid").agg((F.sum(one * F.col("times")) / F.greatest(F.max("n"), F.lit(1))).alias("ratio")) \
        .select(F.col("rid").alias("r"), F.col("ratio").alias(name))
    return docs.join(sums, F.col(rid) == F.col("r")).drop("r", rid)


def _with_ratio(docs: DataFrame, keep: list[str], name: str, word_rows: DataFrame, pair_rows: DataFrame, sent) -> DataFrame:
    """``keep`` columns of the documents and the ratio; sent: the model at the tasks, if it is small enough."""
    if sent is None:
        return _joined_ratios(docs, name, word_rows, pair_rows).select(*columns(keep), name)
    text = own_name(docs, "scored_text")
    rows = docs.select(*columns(keep), F.coalesce(F.col("text"), F.lit("")).alias(text))
    schema = T.StructType([*docs.select(*columns(keep)).schema.fields, T.StructField(name, T.DoubleType())])
    return plain(rows).mapInArrow(partial(_score, sent=sent, names=[*keep, name]), schema)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Scale, slope and offset of the logistic of x / scale over rows that count n times, by Newton steps with a small ridge."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0, 10.0 if len(y) and y.max() else -10.0
    scale = float(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n))) or 1.0
    z, b = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (n * p * (1 - p))[:, None]) + 1e-2 * np.eye(2), z.T @ (n * (y - p)) - 1e-2 * b)
        b += step * min(1.0, 3.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return scale, float(b[0]), float(b[1])


def toxicity(docs: DataFrame, labels: DataFrame, *, keep: list[str] | None = None, score_col: str = "score",
             sent_entries: int = SENT_ENTRIES) -> DataFrame:
    """The documents' ``keep`` columns (default: all) with ``score_col``, 0 to 1.

    Labels are learnt only from ids whose crc32 (of the id as text) modulo 3 is
    not 1; the rest are held out.  Null texts are empty; a text without words
    has ratio 0.  Rows with a null id are scored too; ids that are labelled
    twice count as toxic if one label says so; repeated rows are scored alike.
    With labels of one class or none every text gets the same score.  Extra
    columns pass through; the score takes a longer name where they have its.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    clean = stored(_clean_labels(labels).where(training_fold(F.col("doc_id"))))
    apart = calibration_part(F.col("doc_id"))
    word_rows, pair_rows = fit_model(fit_counts(slim, clean.where(~apart)))
    sent = None
    if word_rows.count() + pair_rows.count() <= sent_entries:
        sent = docs.sparkSession.sparkContext.broadcast(_sent_model(word_rows, pair_rows))
    sample = stored(clean.where(apart).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    fit = _with_ratio(slim.join(F.broadcast(sample), "doc_id"), ["toxic"], "ratio", word_rows, pair_rows, sent) \
        .groupBy("toxic", F.round("ratio", 4).alias("ratio")).count().orderBy("toxic", "ratio").toArrow()
    scale, slope, offset = _logistic(*(fit.column(c).to_numpy().astype(float) for c in ("ratio", "toxic", "count")))
    ratio = own_name(docs, "ratio")
    keep = docs.columns if keep is None else keep
    scored = _with_ratio(docs, keep, ratio, word_rows, pair_rows, sent)
    score_col = own_name(docs.select(*columns(keep)), score_col)
    return scored.withColumn(score_col, 1 / (1 + F.exp(-(F.lit(slope / scale) * F.col(ratio) + F.lit(offset))))).drop(ratio)


def without_toxic(docs: DataFrame, labels: DataFrame, *, limit: float = 0.7) -> DataFrame:
    """The documents that score below ``limit``, with all their columns."""
    score = own_name(docs, "toxic_score")
    return toxicity(docs, labels, score_col=score).where(F.col(score) < limit).drop(score)
