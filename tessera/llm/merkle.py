"""Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf of its source's ternary tree, and the subroots are the
leaves of one more such tree.  A tree is cut into superblocks of 3**7 leaves.
Going up, each superblock is reduced to one node in one group, level after
level of superblocks, until a source has one node.  Going down, the nodes of a
superblock are cogrouped with the one list of outer nodes that their parent
needs for its proof, and at last the leaves of a superblock are cogrouped with
theirs: that one group finishes the local reduction, joins the proof's inner
and outer parts and folds the leaf up to the root.  No group holds more than a
superblock, whatever the size of a source.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

ARITY = 3
#: Levels of a superblock: 3**7 leaves at most.
LEVELS = 7
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree string, pos long, n long, name string, digest binary"
_OUTER = "tree string, pos long, name string, outer array<string>"
_PROVED = "ident string, leaf string, subroot string, proof_sha256 string, folded_root string"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Iterable[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def combined(run: list[bytes]) -> bytes:
    """Node above a run: hash of the digests as hex text, one after another."""
    return sha256("".join(d.hex() for d in run).encode()).digest()


def reduction(nodes: pd.DataFrame, height: int) -> list[list[bytes]]:
    """The levels of one superblock, the given nodes first: ``height`` more, or
    up to the level of one node where the superblock is the whole tree."""
    levels, alone = [[bytes(d) for d in nodes["digest"]]], int(nodes["n"].iloc[0]) <= ARITY**height
    while len(levels[-1]) > 1 if alone else len(levels) <= height:
        below = levels[-1]
        levels.append([combined(below[i: i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[bytes]], i: int) -> list[str]:
    """What a node's run holds before and after it, as ``before,after`` in hex, for each level."""
    steps = []
    for level in levels[:-1]:
        run = i - i % ARITY
        steps.append("".join(d.hex() for d in level[run: i]) + "," + "".join(d.hex() for d in level[i + 1: run + ARITY]))
        i //= ARITY
    return steps


def folded(digest: bytes, steps: list[str]) -> str:
    """Root that a node and its siblings give."""
    node = digest.hex()
    for step in steps:
        before, after = step.split(",")
        node = sha256((before + node + after).encode()).hexdigest()
    return node


def _reduce(key: tuple, nodes: pd.DataFrame, *, height: int) -> pd.DataFrame:
    """One superblock to its node."""
    nodes = nodes.sort_values("pos")
    n, top = int(nodes["n"].iloc[0]), reduction(nodes, height)[-1][0]
    return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // ARITY**height)], "name": [nodes["name"].iloc[0]], "digest": [top]})


def _join_proofs(nodes: pd.DataFrame, outer: pd.DataFrame, *, height: int) -> pd.DataFrame:
    """The list of outer nodes of every node of a superblock, which keeps its name or else has its parent's."""
    nodes = nodes.sort_values("pos")
    levels, rest = reduction(nodes, height), list(outer["outer"].iloc[0])
    return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "name": nodes["name"].fillna(outer["name"].iloc[0] or ""),
                         "outer": [siblings(levels, i) + rest for i in range(len(nodes))]})


def _prove(leaves: pd.DataFrame, outer: pd.DataFrame, *, height: int) -> pd.DataFrame:
    """Proof and folded root of every leaf of a superblock; the outer list's name is the subroot."""
    leaves = leaves.sort_values("pos")
    levels, rest, subroot = reduction(leaves, height), list(outer["outer"].iloc[0]), outer["name"].iloc[0]
    out = []
    for i, (ident, digest, altered) in enumerate(zip(leaves["ident"], levels[0], leaves["altered"], strict=True)):
        steps = siblings(levels, i) + rest
        out.append((ident, digest.hex(), subroot, sha256("".join(steps).replace(",", "").encode()).hexdigest(),
                    folded(digest if altered is None else bytes(altered), steps)))
    return pd.DataFrame(out, columns=["ident", "leaf", "subroot", "proof_sha256", "folded_root"])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos`` (place in its ``tree``, from 0, by ``order``) and ``n`` (rows of the tree).

    Rows are range-partitioned by tree and order, so a tree of any size is
    spread over many tasks; each task counts its rows of a tree, and only the
    counts are added up over tasks.
    """
    placed = stored(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    runs = placed.groupBy(task.alias("task"), "tree").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    whole = Window.partitionBy("tree")
    runs = runs.withColumn("n", F.sum("held").over(whole)) \
        .withColumn("ahead", F.coalesce(F.sum("held").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.withColumn("task", task).join(runs, ["task", "tree"]) \
        .withColumn("pos", F.col("at") - F.col("first") + F.col("ahead")).drop("task", "at", "first", "held", "ahead")


def climbed(nodes: DataFrame, height: int) -> list[DataFrame]:
    """(tree, pos, n, name, digest) of every level of superblocks, up to one node a tree."""
    levels = [nodes]
    while True:
        up = levels[-1].select("tree", F.floor(F.col("pos") / ARITY**height).alias("block"), "pos", "n", "name", "digest") \
            .groupBy("tree", "block").applyInPandas(partial(_reduce, height=height), _NODE)
        levels.append(stored(up))
        if (levels[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return levels


def cogrouped(nodes: DataFrame, outer: DataFrame, join, schema: str, height: int) -> DataFrame:
    """Nodes (or leaves) and the outer list of their superblock meet in one group."""
    mine = nodes.withColumn("block", F.floor(F.col("pos") / ARITY**height)).groupBy("tree", "block")
    return mine.cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(partial(join, height=height), schema)


def descended(levels: list[DataFrame], outer: DataFrame, height: int) -> DataFrame:
    """Outer lists (tree, pos, name, outer) of the superblocks of the lowest level, from that of each tree's root."""
    for nodes in reversed(levels[1:-1]):
        outer = stored(cogrouped(nodes, outer, _join_proofs, _OUTER, height))
    return outer


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
             altered: dict[str, Column] | None = None, height: int = LEVELS) -> DataFrame:
    """One row per document: ``id_col``, leaf, subroot, root, proof_sha256,
    folded_root and verified (the folded root is the root); hex text.

    A leaf hashes ``fields``.  Leaves of a source ascend by id (null ids
    first, equal ids by leaf), sources ascend bytewise (null first, a source
    of its own).  ``altered`` gives new values of some fields: the folded root
    starts from the leaf they give, the siblings stay, so a row verifies only
    if its leaf is what it was.  ``height`` is the superblocks' height.  Nulls hash as ``-``, unlike an empty text;
    repeated rows are leaves beside each other and may change places; no rows
    give no rows; other columns are ignored, whatever they are called.
    """
    altered = altered or {}
    own, new = [F.col(f"`{f}`") for f in fields], [altered.get(f, F.col(f"`{f}`")) for f in fields]
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(
        F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source)).alias("tree"), F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{id_col}`").cast("string").alias("ident"), leaf_digest(own).alias("digest"), leaf_digest(new).alias("altered"))
    rows = rows.withColumn("altered", F.when(F.col("altered") != F.col("digest"), F.col("altered"))).withColumn("rid", F.monotonically_increasing_id())
    leaves = numbered(rows, "id", "digest", "rid").withColumn("name", F.lit(None).cast("string")).drop("rid", "id")

    own_levels = climbed(leaves.select("tree", "pos", "n", "name", "digest"), height)
    subroots = own_levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = numbered(subroots, "name").select("tree", "pos", "n", "name", "digest")
    top_levels = climbed(tops, height)
    peak = top_levels[-1]
    start = peak.select("tree", "pos", "name", F.array().cast("array<string>").alias("outer"))
    above = cogrouped(tops, descended(top_levels, start, height), _join_proofs, _OUTER, height)
    above = above.join(subroots.select("name", F.lower(F.hex("digest")).alias("subroot")), "name")
    outer = descended(own_levels, stored(above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("subroot").alias("name"), "outer")), height)

    proved = cogrouped(leaves.select("tree", "pos", "n", "ident", "digest", "altered"), outer, _prove, _PROVED, height)
    root = peak.select(F.lower(F.hex("digest")).alias("root")).first()  # one digest
    root = F.lit(root["root"] if root else None).cast("string")
    ident = F.col("ident").cast(docs.schema[id_col].dataType).alias(id_col)
    return proved.select(ident, "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
