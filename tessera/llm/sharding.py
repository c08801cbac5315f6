"""Uniform shuffle into shards of exact size, in DataFrame operations only.

A hypergeometric communication matrix says how many rows of every input
partition go to every shard.  Rows are permuted within their partition, dealt
to the shards by the matrix, and permuted again within the shard.  Both
permutations are pseudorandom bijections of row numbers, so no partition and
no shard is ever sorted or gathered in one task; rows move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import let
from tessera.llm.common import columns, own_name, packed, permuted, stored
from tessera.llm.matrix import communication_matrix

#: Counts of the matrix that are sent to every task; a larger matrix is joined, which moves the rows once more.
SENT_COUNTS = 1_000_000
#: Bytes of rows, at their mean size, that leave in one task.
TASK_BYTES = 128 << 20
_SHIFT = 33  # monotonically_increasing_id(): partition above, row number below


def _bytes(names: list[str]) -> Column:
    """About the bytes of a packed row: those of its values as text, and 8 a column."""
    return sum((F.coalesce(F.octet_length(c.cast("string")), F.lit(0)).cast("long") for c in columns(names, "row")), F.lit(8 * len(names)).cast("long"))


def shuffled(rows: DataFrame, n_shards: int, *, seed: int = 7, task_bytes: int = TASK_BYTES) -> DataFrame:
    """All rows with ``shard`` (0 to n_shards - 1) and ``slot`` (0, 1, ... without
    gaps in each shard); shard sizes differ by one row at most.

    Every order of all rows is about equally likely.  The rows are written
    once, so that a lost executor cannot change which row is which.  Nothing is
    read from the columns: nulls, repeated rows, long texts and any extra
    columns are dealt alike, and the new columns take a longer name where the
    rows have theirs.  No rows, no shards.  About ``task_bytes`` of a shard's
    rows leave in one task; places are drawn, so no part holds more long texts
    than chance gives it.
    """
    shard, slot = own_name(rows, "shard"), own_name(rows, "slot")
    named = stored(packed(rows, mark=F.monotonically_increasing_id()))
    sizes = stored(named.groupBy(F.shiftright("mark", _SHIFT).alias("id")).agg(F.count("*").alias("n"), F.sum(_bytes(rows.columns)).alias("bytes")))
    total, held = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    sizes = sizes.select("id", "n")
    rows_per_task = max(1, task_bytes * total // max(1, held))
    goal = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.lit(total // n_shards).cast("long") + (s < total % n_shards).cast("long"))
    matrix = communication_matrix(sizes, goal, seed)
    plan = stored(matrix.join(sizes, "id"))
    plan = F.broadcast(plan) if plan.count() * n_shards <= SENT_COUNTS else plan

    row = F.col("mark").bitwiseAND((1 << _SHIFT) - 1)
    place = permuted(row, F.col("n"), F.xxhash64(F.lit(seed), F.lit("within"), F.col("id")))
    # the shard whose run of places holds this one, and the place within the run
    start = F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("at"))
    found = let(place, lambda p: F.aggregate(F.sequence(F.lit(0), F.lit(n_shards - 1)), start, lambda z, s: F.struct(
        F.when((p >= z["end"]), s).otherwise(z["s"]).alias("s"),
        (z["end"] + F.get("counts", s)).alias("end"),
        F.when(p >= z["end"], p - z["end"]).otherwise(z["at"]).alias("at")), lambda z: F.struct(z["s"].alias("s"), z["at"].alias("at"))))
    dealt = named.join(plan, F.shiftright("mark", _SHIFT) == F.col("id")).withColumn("found", found)
    first = F.get("offsets", F.col("found.s")) + F.col("found.at")
    size = F.lit(total // n_shards).cast("long") + (F.col("found.s") < total % n_shards).cast("long")
    out = dealt.select("row.*", F.col("found.s").alias(shard), permuted(first, size, F.xxhash64(F.lit(seed), F.lit("shard"), F.col("found.s"))).alias(slot))
    return out.repartition(F.col(shard), F.floor(F.col(slot) / rows_per_task))
