"""Connected components of an undirected link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Pairs that one task takes.
TASK_PAIRS = 100_000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links(a, b)``; component is the
    smallest node reachable.  Node ids are longs without nulls.

    Each round ties every node and its neighbours to the smallest of them
    (first towards larger neighbours, then among smaller ones), so long
    chains halve; it ends when a round changes nothing.  Both halves are
    minima per node, which pre-aggregate, so a hub's links meet as one value
    per task.  Rows that go two ways are exploded: a union would plan all that
    lies below it twice, and so each round sixteen times.

    Pairs that fill one task only are read by one, and what is joined to them
    is sent to it, so their rounds need no shuffle; more pairs are shuffled.
    """
    def ways(df: DataFrame, *uv: Column) -> DataFrame:
        return df.select(F.explode(F.array(*uv)).alias("p")).where("p is not null").select("p.u", "p.v")

    def way(u: str, v: str) -> Column:
        return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))

    pairs = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rows, seen = pairs.count(), None
    while True:
        few = rows <= TASK_PAIRS
        both = ways(pairs.coalesce(1) if few else pairs, way("u", "v"), way("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(F.broadcast(least) if few else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(F.broadcast(small_least) if few else small_least, "u")
        pairs = stored(ways(small, way("u", "m"), F.when(F.col("v") != F.col("m"), way("v", "m"))).distinct())
        state = tuple(pairs.agg(F.count("*"), F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1000003), F.lit(0))).first())
        if state == seen:
            break
        rows, seen = state[0], state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v"), F.col("v")).distinct())
