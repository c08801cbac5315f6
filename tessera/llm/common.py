"""Column helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import let
from tessera.session import ensure_checkpoint_dir

#: White space between words: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def stored(df: DataFrame) -> DataFrame:
    """Rows written to the cluster's checkpoint folder: lineage is cut and
    every consumer reads the same rows, also after an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def own_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (case-blind)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def columns(names: Iterable[str], of: str = "") -> list[Column]:
    """The columns (or fields of the struct ``of``) of these names, dots and back quotes in them included."""
    return [F.col((of and of + ".") + "`" + c.replace("`", "``") + "`") for c in names]


def plain(df: DataFrame) -> DataFrame:
    """The same columns under plain names: mapInArrow looks its columns up by names that it reads as paths."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row`` beside ``more``, so that none of their names can clash."""
    return df.select(F.struct(*columns(df.columns)).alias("row"), *[c.alias(n) for n, c in more.items()])


def words_of(text: Column) -> Column:
    """Array of the words of a text; null or blank text gives no words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def unit(*key: Column) -> Column:
    """A number in (0, 1) fixed by ``key``."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def permuted(x: Column, n: Column, seed: Column, rounds: int = 40) -> Column:
    """Pseudorandom bijection of 0..n-1, evaluated at ``x``: the swap-or-not
    shuffle.  Each round pairs x with (k - x) mod n and a hash of the pair
    decides whether the two change places, so every round is its own inverse
    and no row has to see another one."""
    def swap(v: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(seed, i), n) - v, n)
        return let(partner, lambda p: F.when(
            F.pmod(F.xxhash64(seed, i, F.greatest(v, p)), F.lit(2)) == 1, p).otherwise(v))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swap)


def permuted_column(df: DataFrame, x: str, n: str, seed: str, rounds: int) -> DataFrame:
    """``permuted`` of column ``x`` by the columns ``n`` and ``seed``, in place.

    For very many rows: every round is a projection, so that all of it is
    generated code, where ``aggregate`` is interpreted for each row and round.
    Store the rows before filtering or joining by ``x``: a filter pushed
    through the rounds would be doubled by each.
    """
    others = columns(c for c in df.columns if c != x)
    for i in range(1, rounds + 1):
        key = [F.col(seed), F.lit(i)]
        apart = F.pmod(F.xxhash64(*key), F.col(n)) - F.col(x)
        partner = apart + F.shiftright(apart, 63).bitwiseAND(F.col(n))
        swap = -F.xxhash64(*key, F.greatest(F.col(x), partner)).bitwiseAND(F.lit(1))  # all bits or none
        df = df.select(*others, F.col(x).bitwiseXOR(F.col(x).bitwiseXOR(partner).bitwiseAND(swap)).alias(x))
    return df
