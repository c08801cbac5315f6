"""Nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is cut into balanced parts, and a small
classifier learns the part from the vector.  Every vector is indexed under its
most probable part; a query looks into its several most probable parts, and
the cosine to every vector there decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Distinct vectors that graph and classifier are fitted on, at most.
FIT_VECTORS = 4096
#: Distinct vectors to a part, on average, while the sample holds enough rows of each part.
PART_VECTORS, PART_SAMPLE = 4096, 32
#: Share of a held-out sample's true neighbours that the probed parts must hold.
#: Share of the sample's vectors that count as unlike the rest.
UNLIKE = 0.02
AIM = 0.97
_NEIGHBOURS, _SLACK, _HIDDEN, _EPOCHS = 10, 1.1, 128, 25
#: Rows of a part and queries to it that meet in one task; larger parts are cut into pieces.
PIECE_ROWS, PIECE_QUERIES = 8192, 1024


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 512):
        near = x[lo: lo + 512] @ x.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -np.inf
        out[lo: lo + 512] = np.argpartition(near, -k, axis=1)[:, -k:] if k else out[lo: lo + 512]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each vertex, none larger than _SLACK times the mean: median
    splits along main directions, then sweeps that move a vertex to the part of
    most of its neighbours while there is room."""
    label = np.zeros(len(x), np.int64)

    def split(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1 or len(rows) < 2:
            label[rows] = first
            return
        own = x[rows] - x[rows].mean(axis=0)
        direction = rng.normal(size=x.shape[1])
        for _ in range(8):
            direction = own.T @ (own @ direction)
            direction /= np.linalg.norm(direction) or 1.0
        left = count // 2
        order = rows[np.argsort(own @ direction, kind="stable")]
        cut = len(rows) * left // count
        split(order[:cut], first, left)
        split(order[cut:], first + left, count - left)

    split(np.arange(len(x)), 0, parts)
    # edges both ways, as neighbours of each vertex
    a = np.repeat(np.arange(len(x)), graph.shape[1])
    ends = np.concatenate([graph.ravel(), a])
    heads = np.concatenate([a, graph.ravel()])
    order = np.argsort(heads, kind="stable")
    ends, bounds = ends[order], np.searchsorted(heads[order], np.arange(len(x) + 1))
    sizes = np.bincount(label, minlength=parts)
    most = int(np.ceil(_SLACK * len(x) / parts))
    for _ in range(10):
        moved = 0
        for v in rng.permutation(len(x)):
            votes = np.bincount(label[ends[bounds[v]: bounds[v + 1]]], minlength=parts)
            best = int(np.argmax(np.where(sizes < most, votes, -1)))
            if votes[best] > votes[label[v]]:
                sizes[label[v]] -= 1
                sizes[best] += 1
                label[v] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return label


@dataclass
class Classifier:
    """One hidden layer; gives the log-odds of each part."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w + self.b, 0) @ self.v + self.c


def fit_classifier(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> Classifier:
    """Adam on the cross entropy with a distribution over parts for each row."""
    d, p = x.shape[1], target.shape[1]
    params = [rng.normal(size=(d, _HIDDEN)) * np.sqrt(2 / d), np.zeros(_HIDDEN), rng.normal(size=(_HIDDEN, p)) * np.sqrt(1 / _HIDDEN), np.zeros(p)]
    first, second, step = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params], 0
    for epoch in range(_EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            rows = order[lo: lo + 256]
            hidden = np.maximum(x[rows] @ params[0] + params[1], 0)
            z = hidden @ params[2] + params[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            slope = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (slope @ params[2].T) * (hidden > 0)
            step += 1
            for k, g in enumerate((x[rows].T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= 3e-3 * (1 - epoch / _EPOCHS) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Classifier(*params)


@dataclass
class Router:
    """Classifier, the probability that the probed parts must add up to, and
    the cosine to the k-th nearest below which a vector is unlike the sample."""

    classifier: Classifier | None
    mass: float
    usual: float

    def best(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of each vector."""
        return np.zeros(len(x), np.int64) if self.classifier is None else self.classifier.odds(x).argmax(axis=1)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """Which parts each query looks into: the most probable ones, until they add up to ``mass``."""
        if self.classifier is None:
            return np.ones((len(x), 1), bool)
        before, order = masses(self.classifier.odds(x))
        out = np.zeros(before.shape, bool)
        np.put_along_axis(out, order, before < self.mass, axis=1)
        return out


def masses(odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability before each part in falling order, and that order."""
    p = np.exp(odds - odds.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    order = np.argsort(-p, axis=1, kind="stable")
    ranked = np.take_along_axis(p, order, axis=1)
    return np.cumsum(ranked, axis=1) - ranked, order


def fit(x: np.ndarray, parts: int, k: int = 5, seed: int = 5) -> Router:
    """Router of a sample of unit vectors.

    Four fifths give the graph, its parts and the classifier; a row's target is
    the share of its neighbourhood, itself included, that lies in each part.
    The rest are queries that tell how much probability must be probed so that
    the parts hold a share AIM of their k nearest, and how near these usually are.
    """
    if parts < 2 or len(x) < 2 * parts:
        return Router(None, 1.0, -2.0)
    rng = np.random.default_rng(seed)
    asked = np.arange(len(x)) % 5 == 0
    own = x[~asked]
    graph = neighbour_graph(own, _NEIGHBOURS)
    label = balanced_parts(own, graph, parts, rng)
    target = np.zeros((len(own), parts))
    np.add.at(target, (np.arange(len(own)), label), 1.0 + graph.shape[1] / 2)
    np.add.at(target, (np.repeat(np.arange(len(own)), graph.shape[1]), label[graph].ravel()), 1.0)
    model = fit_classifier(own, target / target.sum(axis=1, keepdims=True), rng)
    score = x[asked] @ own.T
    near = np.argsort(-score, axis=1)[:, :k]
    before, order = masses(model.odds(x[asked]))
    home = model.odds(own).argmax(axis=1)[near]
    rank = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(before, np.take_along_axis(rank, home, axis=1), axis=1).ravel())
    usual = np.sort(np.take_along_axis(score, near[:, -1:], axis=1).ravel())
    return Router(model, float(np.nextafter(needed[min(len(needed) - 1, int(AIM * len(needed)))], 2.0)), float(usual[int(UNLIKE * len(usual))]))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def _index(batches: Iterator[pa.RecordBatch], *, sent, probe: bool) -> Iterator[pa.RecordBatch]:
    """(cid, first_id, vec) with the vector's part, or one row for each part to probe."""
    router = sent.value
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _unit(_vectors(batch.column(2)))
        rows, parts = np.nonzero(router.probed(x)) if probe else (np.arange(len(x)), router.best(x))
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns], pa.array(parts.astype(np.int32))], names=["cid", "first_id", "vec", "part"])


def _nearest(asked: pa.Table, there: pa.Table, *, k: int) -> pa.Table:
    """The k nearest other classes of each query among a piece of a part."""
    names = ["query", "cid", "first_id", "score"]
    q, c = asked.column("cid").to_numpy(), there.column("cid").to_numpy()
    if not len(q) or not len(c):
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=names)
    x, y = _vectors(asked.column("vec")), _vectors(there.column("vec"))
    first = there.column("first_id").to_numpy()
    score = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
    score[q[:, None] == c[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(first, score.shape), -score), axis=1)[:, :k]
    best = np.take_along_axis(score, order, axis=1).ravel()
    keep = best > -np.inf
    return pa.table([np.repeat(q, order.shape[1])[keep], c[order].ravel()[keep], first[order].ravel()[keep], best[keep]], names=names)


def usable(vec: Column) -> Column:
    """Vectors without null or non-finite components and not all zero."""
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vec, lambda v: v != 0)


def one_vector_an_id(rows: DataFrame) -> DataFrame:
    """Rows (id, vec, asked, h, g), without repeats; of an id's several vectors the smallest by hash stays."""
    spread = rows.groupBy("id").agg(F.min(F.struct("h", "g")).alias("one"), F.max(F.struct("h", "g")).alias("other")).where("one <> other")
    several = stored(spread.select(F.col("id").alias("several"), "one"))
    if not several.isEmpty():
        rows = rows.join(several, F.col("id") == F.col("several"), "left").where("several is null or struct(h, g) = one").drop("several", "one")
    return rows


def nearest(vectors: DataFrame, asked: Column, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every row that
    ``asked`` is true for, by cosine in double precision, nearest first, ties to
    the smaller id; all others if there are fewer.

    A query probes the parts that the classifier finds likely.  Where these
    hold fewer than k others, or the k-th found is farther than nearly all of
    the sample's, it is unlike the sample and meets all parts.

    Equal vectors form a class with its k + 1 smallest ids, so copies are never
    compared with one another, and a vector that a third of the rows share is
    one candidate.  Classes are indexed under one part each and cut into pieces
    of bounded size; a query meets every piece of the parts that it probes.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without an id or vectors of another length than the most
    frequent one.  A query's own id is never its neighbour.  Of an id's several
    vectors the smallest by hash takes part; repeated rows count once.  Extra columns are
    ignored.  The classifier is fitted on FIT_VECTORS distinct vectors at most,
    the first ones by hash.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(asked, F.lit(False)).alias("asked")) \
        .where(F.col("id").isNotNull() & usable(F.col("vec")))
    width = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.col("count").desc(), F.col("w").desc()).first()
    rows = rows.where(F.size("vec") == (width["w"] if width else 0)).withColumn("h", F.xxhash64("vec")).withColumn("g", F.xxhash64(F.lit(1), "vec"))
    rows = one_vector_an_id(rows)
    first = rows.dropDuplicates(["h", "g", "id"]).withColumn("rn", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).where(F.col("rn") <= k + 1)
    marks = rows.where("asked").groupBy("h", "g").agg(F.min("id").alias("q"))
    classes = first.groupBy("h", "g").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec")) \
        .join(marks, ["h", "g"], "left")
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "h", "g", "ids", F.col("ids")[0].alias("first_id"), "vec", F.col("q").isNotNull().alias("asked")))

    total = classes.count()
    sample = classes.orderBy("h", "g").limit(FIT_VECTORS).select("vec").toArrow()
    x = _unit(_vectors(sample.column("vec")))
    parts = max(1, min(max(16, total // PART_VECTORS), len(x) // PART_SAMPLE))
    sent = spark.sparkContext.broadcast(router := fit(x, parts, k))
    schema = "cid long, first_id long, vec array<double>, part int"
    slim = classes.select("cid", "first_id", "vec")
    there = stored(slim.mapInArrow(partial(_index, sent=sent, probe=False), schema))
    wanted = stored(classes.where("asked").select("cid", "first_id", "vec").mapInArrow(partial(_index, sent=sent, probe=True), schema))

    held = stored(there.groupBy("part").agg(F.ceil(F.count("*") / PIECE_ROWS).alias("pieces")))  # at most one row a part

    def searched(wanted: DataFrame) -> DataFrame:
        """(query, cid, first_id, score, rn) of the k nearest classes in the parts that each query wants."""
        # pieces of large parts, and of many queries to one part
        sizes = F.broadcast(stored(held.join(wanted.groupBy("part").agg(F.ceil(F.count("*") / PIECE_QUERIES).alias("shifts")), "part")))
        here = there.join(sizes, "part").select("cid", "first_id", "vec", "part", F.pmod(F.xxhash64("cid"), "pieces").alias("piece"),
                                                F.explode(F.sequence(F.lit(0).cast("long"), F.col("shifts") - 1)).alias("shift"))
        asks = wanted.join(sizes, "part").select("cid", "first_id", "vec", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"),
                                                 F.pmod(F.xxhash64("cid"), "shifts").alias("shift"))
        keys = ("part", "piece", "shift")
        found = asks.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInArrow(lambda a, b: _nearest(a, b, k=k), "query long, cid long, first_id long, score double")
        return found.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "first_id"))).where(F.col("rn") <= k)

    best = stored(searched(wanted))
    if router.classifier is not None:
        last = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score"))
        asking = classes.where("asked").select("cid", "first_id", "vec")
        unlike = asking.join(last, F.col("cid") == F.col("query"), "left").where(F.col("n").isNull() | (F.col("n") < k) | (F.col("score") < router.usual))
        unlike = stored(unlike.select("cid", "first_id", "vec"))
        if not unlike.isEmpty():
            everywhere = unlike.select("cid", "first_id", "vec", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
            best = best.join(unlike.select(F.col("cid").alias("query")), "query", "left_anti").select(*best.columns).unionByName(searched(everywhere))

    # the class's own copies count as neighbours too
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    own = classes.where("asked and size(ids) > 1").select(F.col("cid").alias("query"), "cid", (F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v) / (norm * norm)).alias("score"))
    rows_of = best.select("query", "cid", "score").union(own).join(classes.select("cid", "ids"), "cid").select("query", "score", F.explode("ids").alias("vec_id"))
    ranked = rows_of.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rn") <= k + 1)
    lists = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("near"))
    answers = classes.select("cid", "h", "g").join(lists, F.col("cid") == F.col("query")).select("h", "g", "near")
    queries = rows.where("asked").select("id", "h", "g").distinct()
    out = queries.join(answers, ["h", "g"]).select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda r: r["vec_id"] != F.col("id")), 1, k)).alias("at", "r"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))

