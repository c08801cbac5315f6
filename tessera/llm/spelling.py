"""Spelling variants of a vocabulary by asymmetric q-chunks.

Of two words, the shorter one (either, if they are as long) contributes two
disjoint chunks, its halves; the other contributes its positional grams of the
halves' lengths.  One edit leaves one half as it is, and moves it by one
position at most, so near words share a chunk that is also a gram of the other
within shift one.  Only grams in those positions are emitted, so one equality
join on (length, place, characters) finds every pair, and each pair is
verified in the join itself.

Chunks that many words share would make that join grow with the square of the
group.  There the rest of the word, which holds the edit, is cut in two again,
and the words meet by the half and a quarter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Runs of letters: A-Z, a-z and the Latin-1 code points from 00C0 on.
RUNS = "[A-Za-zÀ-ÿ]+"
#: Words of a chunk from which on its rest is cut again.
COMMON = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without_point(word: Column, at: Column) -> Column:
    """``word`` without its code point ``at`` (from 0)."""
    return F.concat(F.substr(word, F.lit(1), at.cast("int")), F.substr(word, (at + 2).cast("int")))


def occurrences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = RUNS, dropped: int | None = None) -> DataFrame:
    """(word): every run of letters, with A-Z in lower case.

    With ``dropped``, runs whose crc32 of ``<doc_id>:<run>`` that number
    divides lose one code point; a null id is written as nothing.
    """
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), _UPPER, _LOWER)
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(ident.alias("ident"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("word"))
    if dropped is None:
        return rows.select("word")
    h = F.crc32(F.concat("ident", F.lit(":"), "word").cast("binary"))
    rows = rows.withColumn("h", h)
    return rows.select(F.when(F.col("h") % dropped == 0, without_point(F.col("word"), F.col("h") % F.length("word"))).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, *, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _part(word: Column, start: Column, length: Column) -> Column:
    return F.substr(word, (start + 1).cast("int"), length.cast("int"))


def _chunks(word: Column, size: Column) -> Column:
    """The halves of a word: the shorter word's (length, place, chunk, rest)."""
    half = F.floor(size / 2)
    return F.array(
        F.struct(size.alias("size"), F.lit(0).alias("place"), _part(word, F.lit(0), half).alias("chunk"), _part(word, half, size - half).alias("rest")),
        F.struct(size.alias("size"), F.lit(1).alias("place"), _part(word, half, size - half).alias("chunk"), _part(word, F.lit(0), half).alias("rest")))


def _grams(word: Column, size: Column) -> Column:
    """Grams of a word that can be a half of one as long or one shorter: unmoved, or moved by the one point more."""
    out = []
    for more in (0, 1):
        half = F.floor((size - more) / 2)
        out += [F.struct((size - more).alias("size"), F.lit(0).alias("place"), _part(word, F.lit(0), half).alias("chunk"), _part(word, half, size - half).alias("rest")),
                F.struct((size - more).alias("size"), F.lit(1).alias("place"), _part(word, half + more, size - more - half).alias("chunk"),
                         _part(word, F.lit(0), half + more).alias("rest"))]
    return F.array(*out)


def one_edit(a: Column, b: Column) -> Column:
    """Whether ``b``, as long or one longer, is ``a`` with one code point replaced or inserted."""
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb), once for each pair of (word, n) rows at one edit from each other.

    The words are distinct; null words pair with none.
    """
    size = F.length("word")
    short = words.select("word", "n", F.explode(_chunks(F.col("word"), size)).alias("c")).select("word", "n", "c.*")
    long = words.select("word", "n", F.explode(_grams(F.col("word"), size)).alias("c")).select("word", "n", "c.*")
    key = ["size", "place", "chunk"]
    common = short.groupBy(*key).agg(F.count("*").alias("held")).where(F.col("held") >= COMMON).withColumn("common", F.lit(True)).drop("held")
    common = stored(common)

    def dealt(side: DataFrame, again) -> DataFrame:
        """The chunk alone where few words share it, else with each chunk of the rest."""
        marked = side.join(common, key, "left")
        rest, room = F.col("rest"), F.length("rest")
        finer = F.when(F.col("common"), F.transform(again(rest, room), lambda c: F.struct(
            c["size"].alias("size"), c["place"].alias("place"), c["chunk"].alias("chunk")))).otherwise(
            F.array(F.struct(F.lit(-1).alias("size"), F.lit(0).alias("place"), F.lit("").alias("chunk"))))
        return marked.select("word", "n", *key, F.explode(finer).alias("f")).select(
            "word", "n", *key, F.col("f.size").alias("size2"), F.col("f.place").alias("place2"), F.col("f.chunk").alias("chunk2"))

    a = dealt(short, _chunks).select(F.col("word").alias("a"), F.col("n").alias("na"), *key, "size2", "place2", "chunk2")
    b = dealt(long, _grams).select(F.col("word").alias("b"), F.col("n").alias("nb"), *key, "size2", "place2", "chunk2")
    full = [*key, "size2", "place2", "chunk2"]
    left, right = a.withColumn("k", F.xxhash64(*full)).drop(*full), b.withColumn("k", F.xxhash64(*full)).drop(*full)
    near = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    found = left.join(right, (left["k"] == right["k"]) & near & one_edit(F.col("a"), F.col("b")))
    return found.select("a", "na", "b", "nb").distinct()


def variants(words: DataFrame, *, factor: int = 2) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of each (word, n) row.

    n_near counts the near words.  form is the near word of largest n (ties:
    the first in code-point order) if that n is at least ``factor`` times the
    word's, else null; form_n is its n.  root is where the forms lead, the word
    itself without one: n grows from form to form, so they end.
    """
    words = stored(words)
    pairs = stored(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("other_n")).union(pairs.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    named = words.join(best, "word", "left")
    good = -F.col("best.less") >= factor * F.col("n")
    named = stored(named.select("word", "n", F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"),
                                F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")))
    # every round doubles the way from a word to the word it points to
    ways = stored(named.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("w"), F.col("root").alias("further"))
        step = stored(ways.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ways = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return named.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, *, least_length: int = 5, least_count: int = 3, factor: int = 2, dropped: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, form, form_n, n_near, root) of the words of whole texts.

    Null texts have no words.  Equal rows count as often as they come, other
    columns are ignored, and no words give no rows.  A word as long as a text
    is a word like any other.
    """
    found = occurrences(docs, id_col=id_col, text_col=text_col, dropped=dropped)
    return variants(vocabulary(found, least_length=least_length, least_count=least_count), factor=factor)
