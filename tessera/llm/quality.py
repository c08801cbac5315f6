"""Quality rules under weak supervision, in DataFrame operations only.

Every rule votes good, bad or abstains on a document.  Expectation
maximisation over the counts of vote patterns estimates how often each rule
is right on good and on bad documents; the posterior probability of "good"
given all votes decides, so a single rule's failure does not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import let
from tessera.llm.common import SPACE, columns, own_name, stored, words_of

SYMBOLS = "#*$%&|<>"
#: Name, condition of a bad vote, condition of a good vote; else the rule abstains.
RULES = (
    ("length", "n_words < 50", "n_words >= 80"),
    ("symbols", "n_symbols > 0.08 * n_words", "n_symbols <= 0.01 * n_words"),
    ("word_length", "word_chars < 4.2 * n_words or word_chars > 7 * n_words", "word_chars between 4.5 * n_words and 6.5 * n_words"),
    ("lone_symbols", "n_lone > 0.1 * n_words", "n_lone <= 0.01 * n_words"),
    ("repeated_lines", "n_dup_lines > 0.4 * n_lines", "n_lines > 2 and n_dup_lines < 0.05 * n_lines"),
    ("repeated_words", "n_repeat_words > 0.4 * n_words", "n_words >= 20 and n_repeat_words < 0.1 * n_words"),
    ("capitals", "n_capitals > 0.2 * word_chars", "n_capitals < 0.05 * word_chars"),
    ("line_ends", "n_lines > 2 and n_ended < 0.3 * n_lines", "n_ended > 0.7 * n_lines"),
)
STEPS = 60
#: Start and prior: a rule seldom votes bad on a good document, and sees one kind
#: of fault, so it still votes good on most bad ones.
START = (0.99, 0.8)
PSEUDO_VOTES = 8


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more (the first place counts)."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(k: Column) -> Column:
            def group(j: Column) -> Column:
                return F.get(k, j)["h"]

            twin = F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda j: (group(j) == group(j + 1)).eqNullSafe(F.lit(True))
                            | ((j > 0) & (group(j) == group(j - 1))))
            return F.sort_array(F.transform(twin, lambda j: F.get(k, j)["i"].cast("long")))

        zero = F.lit(0).cast("long")
        union = F.aggregate(let(keyed, places), F.struct((zero - 3).alias("last"), zero.alias("n")), lambda s, p: F.struct(
            p.alias("last"), (s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n")), lambda s: s["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(union)

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(windows, covered))


def measured(docs: DataFrame, text_col: str = "text") -> Column:
    """Struct of the counts that the rules look at, over the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    by_words = let(words_of(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda y: F.substring(F.btrim(y, F.lit(SPACE)), -1, 1).isin(".", "!", "?", '"', ":"))).cast("long").alias("n_ended")))

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    lone = F.regexp_count(text, F.lit(rf"(?<![^\x20\x09-\x0D])[{SYMBOLS}]+(?![^\x20\x09-\x0D])")).cast("long")
    return F.struct(lone.alias("n_lone"), by_words.alias("w"), by_lines.alias("l"), left(r"[\x20\x09-\x0D]+").alias("word_chars"),
                    left(f"[^{SYMBOLS}]+").alias("n_symbols"), left("[^A-Z]+").alias("n_capitals"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_capitals", "n_lone")


def with_measures(docs: DataFrame, text_col: str, names: dict[str, str]) -> DataFrame:
    """The documents with the measures, under ``names``."""
    at = own_name(docs, "measured")
    where = {"n_words": "w.n_words", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines", "n_ended": "l.n_ended"}
    found = docs.withColumn(at, measured(docs, text_col))
    return found.select(*columns(docs.columns), *[F.col(f"{at}.{where.get(m, m)}").alias(names[m]) for m in MEASURES])


def votes(names: dict[str, str]) -> list[Column]:
    """-1 (bad), 1 (good) or 0 for each rule."""
    def own(condition: str) -> Column:
        for m in sorted(MEASURES, key=len, reverse=True):
            condition = condition.replace(m, f"`{names[m]}`" if names[m] != m else m)
        return F.expr(condition)

    return [F.when(own(bad), -1).when(own(good), 1).otherwise(0).cast("tinyint") for _, bad, good in RULES]


def fit(patterns: DataFrame, n_rules: int) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents, and for each rule the probability of a good
    vote on good and on bad documents when it votes.

    ``patterns`` (v array, n count) has at most 3**n_rules rows, so all steps
    are one expression over one row that holds them.  A few pseudo-votes a side
    hold a rule that hardly votes near its start, and keep "good" from changing
    places with "bad".
    """
    def weigh(state: Column, rows: Column) -> Column:
        """Rows with the weights of "good" and "bad"."""
        odds = F.transform(state["odds"], lambda o: F.struct(F.log(o["p"] / o["q"]).alias("up"), F.log((1 - o["p"]) / (1 - o["q"])).alias("down")))
        base = F.log(state["share"] / (1 - state["share"]))

        def one(r: Column, o: Column) -> Column:
            each = F.zip_with(r["v"], o, lambda v, x: F.when(v == 1, x["up"]).when(v == -1, x["down"]).otherwise(0.0))
            good = 1 / (1 + F.exp(-F.aggregate(each, base, lambda t, x: t + x)))
            return let(good, lambda g: F.struct(r["v"].alias("v"), (r["n"] * g).alias("g"), (r["n"] * (1 - g)).alias("b")))

        return let(odds, lambda o: F.transform(rows, lambda r: one(r, o)))

    def total(rows: Column, of) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda t, r: t + of(r))

    def update(rows: Column, j: Column) -> Column:
        def side(c: str, start: float) -> Column:
            good = total(rows, lambda r: F.when(F.get(r["v"], j) == 1, r[c]).otherwise(0.0))
            every = total(rows, lambda r: F.when(F.get(r["v"], j) != 0, r[c]).otherwise(0.0))
            return (good + start * PSEUDO_VOTES) / (every + PSEUDO_VOTES)
        return F.struct(side("g", START[0]).alias("p"), side("b", START[1]).alias("q"))

    def step(state: Column, rows: Column) -> Column:
        def renewed(w: Column) -> Column:
            share = total(w, lambda r: r["g"]) / total(w, lambda r: r["g"] + r["b"])
            return F.struct(F.least(F.greatest(share, F.lit(0.02)), F.lit(0.98)).alias("share"),
                            F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda j: update(w, j)).alias("odds"))
        return let(weigh(state, rows), renewed)

    start = F.struct(F.lit(0.8).alias("share"), F.array_repeat(F.struct(F.lit(START[0]).alias("p"), F.lit(START[1]).alias("q")), n_rules).alias("odds"))
    held = patterns.agg(F.sort_array(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("rows")).where(F.size("rows") > 0)
    end = held.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, _: step(s, F.col("rows"))).alias("s")).first()
    if end is None:
        return 0.8, [START] * n_rules
    return end["s"]["share"], [(o["p"], o["q"]) for o in end["s"]["odds"]]


def posterior(pattern: Column, share: float, odds: list[tuple[float, float]]) -> Column:
    """Probability of "good" given the votes."""
    total = F.lit(math.log(share / (1 - share)))
    for j, (p, q) in enumerate(odds):
        vote = pattern[j]
        total = total + F.when(vote == 1, math.log(p / q)).when(vote == -1, math.log((1 - p) / (1 - q))).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def quality(docs: DataFrame, *, text_col: str = "text", least: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """The documents' ``keep`` columns (default: all) with n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, good (posterior
    probability) and kept.

    base_failed: under 50 words, or more than half of the words lie in
    repeated three-word windows.  kept: not base_failed, and good >= ``least``.
    Null and blank texts have no words and fail the base.  Rows are judged one
    by one, so repeated rows and null ids need no care.  With no rows nothing is
    fitted.  Extra columns pass through; new columns take a longer name where
    the documents have theirs (see ``own_name``).

    Measures and texts are written to the checkpoint folder once; the pattern
    counts and the verdicts are read from there.
    """
    keep = docs.columns if keep is None else keep
    names = {m: own_name(docs, m) for m in MEASURES}
    pattern = own_name(docs, "votes")
    rows = with_measures(docs, text_col, names).select(*columns(keep), *names.values())
    rows = stored(rows.withColumn(pattern, F.array(*votes(names))))
    counts = rows.groupBy(F.col(pattern).alias("v")).agg(F.count("*").alias("n"))
    share, odds = fit(counts, len(RULES))
    n, again = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    failed = (n < 50) | (100 * again > 50 * n)
    good = posterior(F.col(pattern), share, odds)
    return rows.select(*columns(keep), *[names[m] for m in MEASURES[:5]], failed.alias(own_name(docs, "base_failed")),
                       good.alias(own_name(docs, "good")), (~failed & (good >= least)).alias(own_name(docs, "kept")))


def without_poor(docs: DataFrame, **params) -> DataFrame:
    """The documents that quality() keeps, with all their columns."""
    return quality(docs, **params).where(F.col(own_name(docs, "kept"))).select(*columns(docs.columns))
