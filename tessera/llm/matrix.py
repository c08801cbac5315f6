"""Random matrices with given row and column sums, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import let
from tessera.llm.common import unit


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` balls out of ``total`` are among the ``good``
    ones, for a uniform ``u`` in (0, 1): inversion of the distribution.

    Weights relative to the mode follow from their ratios; nine standard
    deviations on each side of it leave less than double precision holds.
    """
    lo = F.greatest(F.lit(0).cast("long"), drawn + good - total)
    hi = F.least(good, drawn)
    n = F.greatest(total, F.lit(1)).cast("double")
    deviation = F.sqrt(drawn * (good / n) * ((total - good) / n) * ((total - drawn) / F.greatest(n - 1, F.lit(1.0))))
    reach = F.ceil(9 * deviation + 9).cast("long")
    mode = F.least(F.greatest(F.floor((drawn + 1) * ((good + 1) / (n + 2))).cast("long"), lo), hi)
    bounds = F.struct(F.greatest(lo, mode - reach).alias("a"), F.least(hi, mode + reach).alias("b"), mode.alias("m"),
                      total.cast("double").alias("t"), good.cast("double").alias("g"), drawn.cast("double").alias("d"))

    def up(w: Column, k: Column, s: Column) -> Column:
        """Weight at k + 1 from that at k."""
        return w * ((s["g"] - k) * (s["d"] - k)) / ((k + 1) * (s["t"] - s["g"] - s["d"] + k + 1))

    def down(w: Column, k: Column, s: Column) -> Column:
        """Weight at k - 1 from that at k."""
        return w * (k * (s["t"] - s["g"] - s["d"] + k)) / ((s["g"] - k + 1) * (s["d"] - k + 1))

    def steps(first: Column, last: Column) -> Column:
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))

    def sums(s: Column, ks: Column, ratio, start: Column) -> Column:
        """(sum, last weight) over the steps away from ``start``'s weight."""
        return F.aggregate(ks, F.struct(F.lit(0.0).alias("sum"), start.alias("w")), lambda z, k: let(
            ratio(z["w"], k.cast("double"), s), lambda w: F.struct((z["sum"] + w).alias("sum"), w.alias("w"))))

    def pick(s: Column) -> Column:
        below = sums(s, F.reverse(steps(s["a"] + 1, s["m"])), down, F.lit(1.0))
        above = sums(s, steps(s["m"], s["b"] - 1), up, F.lit(1.0))

        def walk(p: Column) -> Column:
            """From the lower end if the target lies below the mode, else from the mode."""
            lower = p["target"] < p["below"]["sum"]
            begin = F.when(lower, F.struct(s["a"].alias("x"), p["below"]["w"].alias("w"), p["below"]["w"].alias("acc"))).otherwise(
                F.struct(s["m"].alias("x"), F.lit(1.0).alias("w"), (p["below"]["sum"] + 1).alias("acc")))
            return F.aggregate(
                F.when(lower, steps(s["a"], s["m"] - 1)).otherwise(steps(s["m"], s["b"] - 1)), begin,
                lambda z, k: let(up(z["w"], k.cast("double"), s), lambda w: F.struct(
                    F.when(z["acc"] <= p["target"], k + 1).otherwise(z["x"]).alias("x"), w.alias("w"), (z["acc"] + w).alias("acc"))),
                lambda z: z["x"])

        return let(F.struct(below.alias("below"), above.alias("above")), lambda q: let(
            F.struct(q["below"].alias("below"), (u * (q["below"]["sum"] + 1 + q["above"]["sum"])).alias("target")), walk))

    return F.when(hi <= lo, lo).otherwise(let(bounds, pick))


def communication_matrix(rows: DataFrame, columns: Column, seed: int) -> DataFrame:
    """Deal the ``columns`` sums over rows of given sizes: (id, counts, offsets).

    ``rows`` (id, n) lists the row sums, ``columns`` is an array expression of
    column sums with the same total.  Entry counts[c] is the number of row
    ``id``'s items that go to column c, distributed as if all items had been
    dealt out uniformly at random (multivariate hypergeometric); offsets[c] is
    the sum of that column over the rows before it, by id.

    The rows are halved again and again: a half's share of every column is
    drawn given what both halves hold together, so each level is one
    narrow transformation and all its nodes are drawn in parallel.
    """
    held = rows.agg(F.sort_array(F.collect_list(F.struct("id", F.col("n").cast("long").alias("n")))).alias("leaves"))
    size = held.select(F.size("leaves")).first()[0]
    zeros = F.transform(columns, lambda _: F.lit(0).cast("long"))
    nodes = held.select("leaves", F.transform(columns, lambda c: c.cast("long")).alias("counts"), zeros.alias("offsets")).where(F.size("leaves") > 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x)

    def halves(leaves: Column, counts: Column, offsets: Column) -> Column:
        cut = F.floor(F.size(leaves) / 2).cast("int")
        left = F.slice(leaves, F.lit(1), cut)
        start = F.struct(total(counts).alias("left_items"), F.aggregate(left, F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("draws"),
                         F.array().cast("array<long>").alias("out"))
        key = F.element_at(leaves, 1)["id"]
        drawn = F.aggregate(counts, start, lambda s, c: let(
            hypergeometric(s["left_items"], c, s["draws"], unit(F.lit(seed), key, F.size(leaves), F.size(s["out"]))),
            lambda x: F.struct((s["left_items"] - c).alias("left_items"), (s["draws"] - x).alias("draws"), F.concat(s["out"], F.array(x)).alias("out"))),
            lambda s: s["out"])
        return let(drawn, lambda d: F.array(
            F.struct(left.alias("leaves"), d.alias("counts"), offsets.alias("offsets")),
            F.struct(F.slice(leaves, cut + 1, F.size(leaves) - cut).alias("leaves"), F.zip_with(counts, d, lambda a, b: a - b).alias("counts"),
                     F.zip_with(offsets, d, lambda a, b: a + b).alias("offsets"))))

    level = 0
    while (1 << level) < size:
        whole = F.array(F.struct("leaves", "counts", "offsets"))
        nodes = nodes.select(F.explode(F.when(F.size("leaves") > 1, halves(F.col("leaves"), F.col("counts"), F.col("offsets"))).otherwise(whole)).alias("h")).select("h.*")
        level += 1
        if level % 4 == 0:
            nodes = nodes.repartition(F.element_at("leaves", 1)["id"])
    return nodes.select(F.element_at("leaves", 1)["id"].alias("id"), "counts", "offsets")
