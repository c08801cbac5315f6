"""Matching tables of query points with entities (J3, R5, R6, W8), exactly and
without pairing every query with every entity.

``nearest_entities`` cuts the scaled feature space into cells by k-d splits at
quantiles.  A query's first bound is the distance of its k-th nearest point in
its own cell (or in the smallest part of the tree around it with k points);
then it visits only cells whose box is nearer than that, found by walking down
the tree.  ``closest_ranks`` merges two sorted lists range by range: every
range of ranks carries k ranks over each of its borders, so a query's
neighbours on both sides are in its own range.

Equal points (or ranks) are one row with their k first names, and equal
queries are one query, so repeated values cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import let
from tessera.operators import entities as E
from tessera.session import materialize

#: Points from which the splits are taken, at most (a random sample; results do not depend on it).
SPLIT_SAMPLE = 65_536
#: Points of a cell, as far as MAX_LEVELS splits allow.
CELL_POINTS = 64
MAX_LEVELS = 12
#: Distances are compared to so many decimals, so that rounding errors decide no tie.
DIGITS = 9
_SLACK = 1e-8
#: Ranges of ranks.
RANGES = 256


def splits_of(points: list[tuple[float, ...]], levels: int) -> list[float]:
    """Medians of a k-d tree in breadth-first order; level by level the features take turns."""
    parts, out = [points], []
    for level in range(levels):
        below = []
        for part in parts:
            axis = level % len(points[0])
            part = sorted(part, key=lambda p: p[axis])
            middle = part[(len(part) - 1) // 2][axis] if part else 0.0
            out.append(middle)
            below += [[p for p in part if p[axis] <= middle], [p for p in part if p[axis] > middle]]
        parts = below
    return out


def cell_of(point: list[Column], splits: list[float], levels: int) -> Column:
    """Number of the leaf (2**levels and on) that a point lies in."""
    values = F.array(*point)
    tree = F.lit(splits or [0.0])
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)) if levels else F.array().cast("array<int>"), F.lit(1), lambda node, level: node * 2 + (
        F.get(values, level % len(point)) > F.get(tree, node - 1)).cast("int"))


def nearest_entities(profile: DataFrame, points: DataFrame, *, k: int = 5, features=E.FEATURES, key: str = "entity", id_col: str = "point_id",
                     keep: tuple[str, ...] = ("hec_rank",)) -> DataFrame:
    """J3 + R6 for a table of points: (id_col, rank, key, *keep, distance) of the
    k nearest entities of every row of ``points`` in standard-scaled space.

    Ties (to DIGITS decimals of the distance) go to the smaller key.  A point
    with a null feature gets no rows, and an entity with one is nobody's
    neighbour; with fewer than k entities all of them are given.  A feature
    without spread is centred only.  Repeated points are each answered.
    """
    stats = E._stats_scalar(E.scaling_stats(profile, features))
    z = [f"z{i}" for i in range(len(features))]
    scaled = profile.select(key, *keep, *[E._z(F.col(f).cast("double"), stats, f).alias(c) for c, f in zip(z, features, strict=True)]).na.drop(subset=z)
    # NULLs first, then the k first names of each point
    firsts = Window.partitionBy(*z).orderBy(key)
    scaled = materialize(scaled.withColumn("_r", F.row_number().over(firsts)).where(F.col("_r") <= k).drop("_r"))
    asked = points.select(id_col, *[E._z(F.col(f).cast("double"), stats, f).alias(c) for c, f in zip(z, features, strict=True)]).na.drop(subset=z)
    asked = materialize(asked)

    n = scaled.count()
    sample = scaled.select(*z).sample(min(1.0, SPLIT_SAMPLE / max(n, 1)), 7).limit(2 * SPLIT_SAMPLE).collect()
    levels = max(0, min(MAX_LEVELS, (n // CELL_POINTS).bit_length() - 1)) if sample else 0
    splits = splits_of([tuple(r) for r in sample], levels) if levels else []
    leaf = cell_of([F.col(c) for c in z], splits, levels)
    located = materialize(scaled.withColumn("cell", leaf))
    queries = materialize(asked.select(*[F.col(c).alias(f"q{c}") for c in z]).distinct()
                          .withColumn("home", cell_of([F.col(f"q{c}") for c in z], splits, levels)).withColumn("query", F.xxhash64(*[f"q{c}" for c in z])))

    # boxes of all nodes of the tree, at most 2**(MAX_LEVELS + 1) of them
    up = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda s: F.floor(F.col("cell") / F.pow(F.lit(2.0), s)).cast("int"))).alias("node")
    spans = [F.min(c).alias(f"lo_{c}") for c in z] + [F.max(c).alias(f"hi_{c}") for c in z]
    held = located.groupBy("cell").agg(F.count("*").alias("n"), *spans).select(up, "n", *[f"lo_{c}" for c in z], *[f"hi_{c}" for c in z])
    held = held.groupBy("node").agg(F.sum("n").alias("n"), *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in z], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in z])
    boxes = held.select(F.map_from_entries(F.collect_list(F.struct("node", F.struct(
        "n", F.array(*[f"lo_{c}" for c in z]).alias("lo"), F.array(*[f"hi_{c}" for c in z]).alias("hi"))))).alias("boxes")).first()["boxes"]
    number = 1 << (levels + 1)
    none = [float("inf")] * len(z)
    lows = F.lit([x for i in range(number) for x in (boxes[i]["lo"] if i in boxes else none)])
    highs = F.lit([x for i in range(number) for x in (boxes[i]["hi"] if i in boxes else none)])
    counts = F.lit([int(boxes[i]["n"]) if i in boxes else 0 for i in range(number)])

    point = F.array(*[f"q{c}" for c in z])
    width = len(z)

    def outside(node: Column) -> Column:
        """Distance from the query to a node's box."""
        axes = F.sequence(F.lit(0), F.lit(width - 1))
        square = F.aggregate(axes, F.lit(0.0), lambda s, a: s + let(F.greatest(
            F.get(lows, node * width + a) - F.get(point, a), F.get(point, a) - F.get(highs, node * width + a), F.lit(0.0)), lambda d: d * d))
        return F.sqrt(square)

    def leaves(start: Column, wanted) -> Column:
        """Leaves below ``start`` (an array of nodes), leaving out nodes that are not ``wanted``."""
        steps = F.sequence(F.lit(1), F.lit(levels)) if levels else F.array().cast("array<int>")
        down = lambda nodes, _: F.filter(F.flatten(F.transform(nodes, lambda x: F.when(
            x >= (1 << levels), F.array(x)).otherwise(F.array(x * 2, x * 2 + 1)))), wanted)
        return F.aggregate(steps, start, down)

    # the smallest node around the query that holds k points
    around = F.aggregate(F.sequence(F.lit(1), F.lit(levels)) if levels else F.array().cast("array<int>"), F.col("home"),
                         lambda node, _: F.when(F.get(counts, node) >= k, node).otherwise(F.floor(node / 2).cast("int")))

    def met(visits: DataFrame) -> DataFrame:
        """Distances between queries and the points of the cells they visit."""
        square = None
        for c in z:
            d = F.col(c) - F.col(f"q{c}")
            square = d * d if square is None else square + d * d
        return visits.join(located, "cell").withColumn("distance", F.sqrt(square)).withColumn("_d", F.round("distance", DIGITS))

    best = Window.partitionBy("query").orderBy("_d", key)
    near = met(queries.withColumn("cell", F.explode(leaves(F.array(around), lambda x: F.get(counts, x) > 0))))
    bound = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).groupBy("query").agg(
        F.when(F.count("*") >= k, F.max("_d")).otherwise(F.lit(float("inf"))).alias("bound"))
    bounded = queries.join(bound, "query")
    visits = bounded.withColumn("cell", F.explode(leaves(F.array(F.lit(1)), lambda x: (F.get(counts, x) > 0) & (outside(x) <= F.col("bound") + _SLACK))))
    found = met(visits).where(F.col("_d") <= F.col("bound")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = found.select("query", "rank", key, *keep, "distance")
    named = asked.select(id_col, F.xxhash64(*z).alias("query"))
    return named.join(found, "query").select(id_col, "rank", key, *keep, "distance")


def closest_ranks(profile: DataFrame, predicted: DataFrame, *, k: int = 5, rank: str = "hec_rank", key: str = "entity", id_col: str = "request_id",
                  value: str = "predicted_rank") -> DataFrame:
    """R5 for a table of predicted ranks: (id_col, place, key, rank, rank_diff,
    verdict) of the k entities whose rank is closest to each row's ``value``.

    Ties go to the smaller key.  Null values get no rows and entities without a
    rank are nobody's neighbour; with fewer than k entities all are given.
    """
    first = Window.partitionBy(rank).orderBy(key)
    ranked = profile.select(key, F.col(rank).cast("double").alias(rank)).where(F.col(rank).isNotNull())
    ranked = ranked.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")
    names = materialize(ranked.groupBy(rank).agg(F.collect_list(key).alias("names")))  # k at most
    wanted = materialize(predicted.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull()).distinct())

    both = names.select(F.col(rank).alias("v"), F.lit(True).alias("held")).union(wanted.select("v", F.lit(False)))
    cuts = sorted(set(both.approxQuantile("v", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES)))) or [0.0]
    cell = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("v")))
    both = both.withColumn("cell", cell)

    # k ranks carried over each border, from as many ranges as it takes
    low, high = Window.partitionBy("cell").orderBy("v"), Window.partitionBy("cell").orderBy(F.desc("v"))
    own = both.where("held")
    edges = own.withColumn("_r", F.row_number().over(low)).where(F.col("_r") <= k).groupBy("cell").agg(F.sort_array(F.collect_list("v")).alias("low"))
    edges = edges.join(own.withColumn("_r", F.row_number().over(high)).where(F.col("_r") <= k).groupBy("cell")
                       .agg(F.sort_array(F.collect_list("v"), asc=False).alias("high")), "cell")
    ends = edges.select(F.sort_array(F.collect_list(F.struct("cell", "low", "high"))).alias("ends"))  # RANGES rows of 2 k ranks
    cells = F.sequence(F.lit(0), F.lit(len(cuts)))
    none = F.array().cast("array<double>")

    def of(c: Column, before: bool) -> Column:
        lists = F.filter(F.col("ends"), lambda e: (e["cell"] < c) if before else (e["cell"] > c))
        flat = F.flatten(F.transform(lists, lambda e: e["high"] if before else e["low"]))
        return F.slice(F.sort_array(flat, asc=not before), 1, k)

    carried = ends.select(F.explode(F.transform(cells, lambda c: F.struct(c.alias("cell"), F.concat(
        F.coalesce(of(c, True), none), F.coalesce(of(c, False), none)).alias("vs")))).alias("c"))
    carried = carried.select(F.explode("c.vs").alias("v"), F.lit(True).alias("held"), F.col("c.cell").alias("cell"))

    inside = Window.partitionBy("cell").orderBy("v", F.desc("held")).rowsBetween(Window.unboundedPreceding, 0)
    placed = materialize(both.unionByName(carried).withColumn("at", F.sum(F.col("held").cast("int")).over(inside)))
    asked = placed.where("not held").select(F.col("v").alias("asked"), "cell", F.explode(F.sequence(F.col("at") - (k - 1), F.col("at") + k)).alias("at"))
    near = asked.join(placed.where("held"), ["cell", "at"]).select("asked", F.col("v").alias(rank)).join(names, rank)
    near = near.select("asked", rank, F.explode("names").alias(key)).withColumn("rank_diff", F.abs(F.col(rank) - F.col("asked")))
    best = Window.partitionBy("asked").orderBy(F.round("rank_diff", DIGITS), key)
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    rows = predicted.select(id_col, F.col(value).cast("double").alias("asked"))
    return rows.join(near, "asked").select(id_col, "place", key, rank, "rank_diff", E.rank_verdict(F.col("rank_diff")).alias("verdict"))
