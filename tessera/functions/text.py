"""Review-text column functions (F10-F15, J4-J5), all JVM built-ins.

Tokens are the maximal ``[a-z]+`` runs of the lower-cased text, which is
what "replace every non-[a-z] non-space character by a space, then split on
whitespace" produces.  Stop words and tokens of <= 2 letters are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import let

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results:
# the stop-word list (98 words), the positive lexicon (34 words) and the
# negative lexicon (27 words), in the reference's order.
STOPWORDS = tuple("""a an the is was are were be been have has had do does did will
would could should may might can i me my we our you your he she it its they them
their this that these those of in on at to for with by from up about into through
during before after above below between out off over under again further then once
here there when where why how all both each few more most other some such no nor not
only own same so than too very just but and or as if""".split())

POSITIVE_WORDS = tuple("""great excellent amazing wonderful fantastic good love best perfect
awesome outstanding superb brilliant incredible quality nice happy satisfied recommend
worth beautiful comfortable easy fast quick reliable durable sturdy impressive
delightful pleased enjoy terrific top""".split())

NEGATIVE_WORDS = tuple("""bad terrible awful horrible worst poor broken defective cheap useless
disappointed disappointing waste return refund stopped failed failure problem issue
complaint ugly slow difficult hard broke cheaply""".split())

# Rating rule constants (label, base, step, cap) and text rule constants.
RATING_CAP, RATING_BASE, RATING_STEP, RATING_NEUTRAL = 0.96, 0.62, 0.17, 0.55
TEXT_CAP, TEXT_BASE, TEXT_SPAN, TEXT_NEUTRAL = 0.95, 0.55, 0.40, 0.50
# ---------------------------------------------------------------------------

LABELS = ("Negative", "Neutral", "Positive")  # label codes 0, 1, 2 (sorted)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens(text, stopwords=STOPWORDS, min_len: int = 3) -> Column:
    """Cleaned token array; NULL text gives an empty array."""
    raw = F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z]+"), 0)
    stop = list(stopwords)
    kept = F.filter(raw, lambda t: (F.length(t) >= min_len) & ~t.isin(stop))
    return F.coalesce(kept, F.array().cast("array<string>"))


def clean_text(text, stopwords=STOPWORDS) -> Column:
    """cleaned text (tokens joined by one space)."""
    return F.array_join(tokens(text, stopwords), " ")


def lexicon_hits(toks, words) -> Column:
    """Number of *distinct* tokens found in a lexicon."""
    return F.size(F.array_intersect(F.array_distinct(_c(toks)), _words(words)))


def rating_sentiment(rating) -> dict[str, Column]:
    """label and confidence from a 1-5 rating.

    NULL and NaN ratings are Neutral (0.55): a missing value in a rating
    column is NaN to the reference, and NaN fails both comparisons there.
    """
    r = _c(rating).cast("double")
    missing = r.isNull() | F.isnan(r)
    label = (F.when(missing, "Neutral").when(r >= 4, "Positive")
              .when(r <= 2, "Negative").otherwise("Neutral"))
    conf = (F.when(missing, RATING_NEUTRAL)
             .when(r >= 4, F.least(F.lit(RATING_CAP), RATING_BASE + (r - 4) * RATING_STEP))
             .when(r <= 2, F.least(F.lit(RATING_CAP), RATING_BASE + (3 - r) * RATING_STEP))
             .otherwise(RATING_NEUTRAL))
    return {"sentiment": label, "confidence": conf}


def text_sentiment(toks, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS) -> dict[str, Column]:
    """label and confidence from lexicon hits of the distinct tokens."""
    p = lexicon_hits(toks, positive)
    n = lexicon_hits(toks, negative)
    tot = F.greatest(p + n, F.lit(1)).cast("double")
    label = F.when(p > n, "Positive").when(n > p, "Negative").otherwise("Neutral")
    conf = (F.when(p > n, F.least(F.lit(TEXT_CAP), TEXT_BASE + p / tot * TEXT_SPAN))
             .when(n > p, F.least(F.lit(TEXT_CAP), TEXT_BASE + n / tot * TEXT_SPAN))
             .otherwise(TEXT_NEUTRAL))
    return {"text_sentiment": label, "text_confidence": conf, "pos_hits": p, "neg_hits": n}


def derive_sentiment(rating, toks, prefer_text: bool = False) -> dict[str, Column]:
    """sentiment when the input has none.

    Default follows the reference: the rating rule whenever a rating column
    exists (missing values -> Neutral).  ``prefer_text=True`` uses the
    lexicon rule for rows without a usable rating.
    """
    rs = rating_sentiment(rating)
    if not prefer_text:
        return rs
    ts = text_sentiment(toks)
    r = _c(rating).cast("double")
    usable = r.isNotNull() & ~F.isnan(r)
    return {"sentiment": F.when(usable, rs["sentiment"]).otherwise(ts["text_sentiment"]),
            "confidence": F.when(usable, rs["confidence"]).otherwise(ts["text_confidence"])}


def label_code(sentiment) -> Column:
    """F9 for the fixed sentiment domain: alphabetical code 0..2."""
    s = _c(sentiment)
    return F.when(s == LABELS[0], 0).when(s == LABELS[1], 1).when(s == LABELS[2], 2)


def percent_text(fraction) -> Column:
    """``f"{x*100:.0f}%"`` (half-even like Python's format)."""
    return F.concat(F.bround(_c(fraction) * 100.0, 0).cast("bigint").cast("string"), F.lit("%"))


def preview(text, width: int = 80) -> Column:
    """First ``width`` characters, with an ellipsis when cut."""
    t = _c(text)
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("…"))).otherwise(t)


def stars(rating) -> Column:
    """``★n`` rating badge."""
    return F.concat(F.lit("★"), _c(rating).cast("string"))


def rating_band(rating) -> Column:
    """Low (<= 2) / mid (3) / high (>= 4) band of a rating."""
    r = _c(rating)
    return F.when(r <= 2, "low").when(r == 3, "mid").when(r >= 4, "high")


def keyword_class(name, keywords, hit: str = "Public", miss: str = "Private") -> Column:
    """``hit`` if any keyword is a substring of lower(name).

    Substring semantics are kept on purpose ("national" also matches
    "international").
    """
    low = F.lower(_c(name))
    cond = None
    for k in keywords:
        c = low.contains(k.lower())
        cond = c if cond is None else (cond | c)
    return F.when(cond, hit).otherwise(miss) if cond is not None else F.lit(miss)


def bigrams(toks) -> Column:
    """Adjacent token pairs joined by a space.

    Pairs the array without its last element with the array without its
    first, so the token array is evaluated once per row (referencing it
    inside a per-element lambda would re-evaluate it for every element).
    """
    def pairs(t):
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n),
                          lambda a, b: F.concat(a, F.lit(" "), b))
    return let(_c(toks), pairs)


def uni_bi_grams(toks) -> Column:
    """M10 input: unigrams followed by bigrams."""
    return let(_c(toks), lambda t: F.concat(t, bigrams(t)))
