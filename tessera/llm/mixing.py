"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, laid end to end, are cut into blocks of equal length.
Every output shard draws how many of its slots go to each source
(multinomially, out of what the sources still owe, so all shards together owe
nothing); the slots of a source run through pseudorandom permutations of its
block numbers, one permutation an epoch; and blocks are joined by number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import let
from tessera.llm.common import WORD_CLASS, columns, n_words_of, own_name, packed, permuted_column, stored
from tessera.llm.matrix import communication_matrix

WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its words.
MOST = 3
_ROUNDS = 24
_CHUNK_ROWS = 4096
#: Slots whose blocks are numbered by one task.
TASK_SLOTS = 32_768
#: Sources whose rows are sent to every task; more are joined.
SENT_SOURCES = 100_000


@dataclass
class Mix:
    """rows: the stored input with ``rid`` and ``size``; sources: one row per
    source with its target; pieces: (rid, first word, words, uses) of each
    document's part of each block that some slot takes."""

    rows: DataFrame
    sources: DataFrame
    pieces: DataFrame
    rid: str
    size: str


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, total, docs) with ``pos`` (rank by code point, null last) and
    ``target``: shares by weight of all words, none above MOST times its own.

    A capped share is its cap and the rest is reshared by weight.  With the
    sources in order of cap per weight, the first ones are capped, and the
    words per weight of the others is the largest of the levels that end the
    capping at any source.
    """
    ranked = sizes.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.lit(list(weights)), (F.col("pos") % len(weights) + 1).cast("int")))
    by_cap = Window.orderBy(MOST * F.col("total") / F.col("weight"), "pos")
    everything = Window.partitionBy()
    level = (F.sum("total").over(everything) - F.coalesce(F.sum(MOST * F.col("total")).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("level", level).withColumn(
        "target", F.least((MOST * F.col("total")).cast("double"), F.col("weight") * F.max("level").over(everything))).drop("level", "weight")


def mix(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None,
        weights: tuple[float, ...] = WEIGHTS, block_words: int = 64, shard_slots: int = 4096, seed: int = 11) -> Mix:
    """Plan the mix of all rows; ``keep`` lists the columns to store (default: all).

    A row's words are the runs of other characters than white space; null texts
    have none.  A null source is a source of its own.  Each source gives its
    target to within a block, and every block is used 0 to MOST times, so no
    row is used more.  Positions follow from hashes of the rows' content, so
    reruns agree; repeated rows are laid side by side.  Sources are few (their
    list is sent to every task); rows of a source are dealt over chunks, so a
    source that holds most rows is laid out by many tasks.
    """
    rid, size = own_name(docs, "rid"), own_name(docs, "size")
    keep = docs.columns if keep is None else keep
    text_hash = own_name(docs, "text_hash")
    rows = stored(docs.select(*columns(keep), n_words_of(F.col(text_col)).alias(size), F.monotonically_increasing_id().alias(rid),
                              F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(text_hash)))
    slim = rows.select(F.col(rid).alias("rid"), F.col(id_col).cast("string").alias("ident"), F.col(source_col).cast("string").alias("source"),
                       F.col(size).alias("size"), F.col(text_hash).alias("hash"))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("docs"))
    blocks = F.ceil(F.col("total") / block_words).cast("long")
    slots = F.when(F.col("total") > 0, F.round(F.col("target") * blocks / F.col("total"))).otherwise(0).cast("long")
    sources = stored(source_targets(sizes, weights).withColumn("blocks", blocks).withColumn("slots", slots))

    # where each row lies in its source
    named = slim.where("size > 0").join(sources.select(F.col("source").alias("s"), "pos", "docs"), F.col("source").eqNullSafe(F.col("s")))
    mixed = F.xxhash64(F.lit(seed), "hash", "ident")
    chunks = named.withColumn("order", mixed).withColumn("chunk", F.pmod(F.xxhash64("order"), F.ceil(F.col("docs") / _CHUNK_ROWS)))
    ahead = Window.partitionBy("pos").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunks.groupBy("pos", "chunk").agg(F.sum("size").alias("words")).withColumn("base", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    inside = Window.partitionBy("pos", "chunk").orderBy("order", "hash", "ident", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["pos", "chunk"]) \
        .select("rid", "pos", "size", (F.col("base") + F.col("before")).alias("start"))
    block = F.col("block")
    parts = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))) \
        .withColumn("from", F.greatest(F.col("start"), block * block_words)) \
        .withColumn("to", F.least(F.col("start") + F.col("size"), (block + 1) * block_words)) \
        .select("rid", "pos", "block", (F.col("from") - F.col("start")).alias("first"), (F.col("to") - F.col("from")).alias("words"))

    # stored: the join's filter on the block would be pushed through the rounds and doubled by each
    uses = stored(slot_blocks(docs, sources, shard_slots, seed).groupBy("pos", "block").agg(F.count("*").alias("uses")))
    pieces = parts.join(uses, ["pos", "block"]).select("rid", "first", "words", "uses")
    return Mix(rows, sources, pieces, rid, size)


def slot_blocks(docs: DataFrame, sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(shard, pos, block): the block that fills each slot of each output shard."""
    spark = docs.sparkSession
    owed = [r["slots"] for r in sources.select("pos", "slots").orderBy("pos").collect()]  # one number per source
    total = sum(owed)
    shards = spark.range((total + shard_slots - 1) // shard_slots).select(
        "id", F.least(F.lit(shard_slots).cast("long"), F.lit(total).cast("long") - F.col("id") * shard_slots).alias("n"))
    matrix = communication_matrix(shards, F.lit(owed or [0]).cast("array<long>"), seed)
    drawn = matrix.select(F.col("id").alias("shard"), F.explode(F.arrays_zip("counts", "offsets", F.sequence(F.lit(0), F.size("counts") - 1).alias("pos"))).alias("d")) \
        .select("shard", F.col("d.counts").alias("n"), F.col("d.offsets").alias("at"), F.col("d.pos").alias("pos")).where("n > 0")
    known = sources.select("pos", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    drawn = drawn.join(F.broadcast(known) if len(owed) <= SENT_SOURCES else known, "pos")
    # few small rows become all slots: a number of tasks by the slots, which small tasks are not merged out of;
    # stored, since the draws' expressions would be planned again for every round
    drawn = stored(drawn).repartition(max(1, -(-total // TASK_SLOTS)), "shard", "pos")
    slots = drawn.select("shard", "pos", "blocks", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("j"))
    epoch = F.floor(F.col("j") / F.col("blocks"))
    keyed = slots.select("shard", "pos", "blocks", F.pmod("j", "blocks").alias("block"), F.xxhash64(F.lit(seed), "pos", epoch).alias("key"))
    return permuted_column(keyed, "block", "blocks", "key", _ROUNDS).select("shard", "pos", "block")


def mixed_pieces(plan: Mix, text_col: str = "text") -> DataFrame:
    """(row, whole, piece, uses): the text of each part of a stored row that
    the mix takes, how often, and whether it is the whole text.

    A row's parts meet in one list, no longer than its text, so the text is
    cut into words once and shuffled once.
    """
    parts = plan.pieces.groupBy("rid").agg(F.collect_list(F.struct("first", "words", "uses")).alias("parts"))
    rows = packed(plan.rows, rid=F.col(plan.rid)).join(parts, "rid")
    text = F.col(f"row.`{text_col}`")
    runs = F.regexp_extract_all(text, F.lit(rf"({WORD_CLASS}+[\x20\x09-\x0D]*)"), F.lit(1))
    whole = lambda p: (p["first"] == 0) & (p["words"] == F.col(f"row.`{plan.size}`"))
    pieces = let(runs, lambda r: F.transform("parts", lambda p: F.struct(
        whole(p).alias("whole"), p["uses"].alias("uses"),
        F.when(~whole(p), F.array_join(F.slice(r, (p["first"] + 1).cast("int"), p["words"].cast("int")), "")).alias("piece"))))
    return rows.select("row", F.explode(pieces).alias("p")).select("row", "p.whole", "p.uses", F.when(F.col("p.whole"), text).otherwise(F.col("p.piece")).alias("piece"))


def taken(plan: Mix, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The stored rows (their ``keep`` columns, default: all) with ``taken``:
    words of the pieces that the mix holds of each, repeats counted."""
    counted = mixed_pieces(plan, text_col).select(F.col(f"row.`{plan.rid}`").alias("rid"), (n_words_of(F.col("piece")) * F.col("uses")).alias("words"))
    sums = counted.groupBy("rid").agg(F.sum("words").alias("words"))
    kept = plan.rows.select(*columns(plan.rows.columns if keep is None else keep))
    rows = plan.rows.select(F.col(plan.rid).alias("rid"), F.struct(*columns(kept.columns)).alias("row")).join(sums, "rid", "left")
    return rows.select("row.*", F.coalesce("words", F.lit(0).cast("long")).alias(own_name(kept, "taken")))


def mixed_documents(docs: DataFrame, *, text_col: str = "text", chars_col: str = "n_chars", **params) -> DataFrame:
    """The mix as rows with the documents' columns: each taken piece of a
    document, as often as its block is used, with the white space between its
    words as it was; the length column is the piece's."""
    plan = mix(docs, text_col=text_col, **{"block_words": 1024, **params})
    rows = mixed_pieces(plan, text_col).withColumn("use", F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses"))))
    return rows.select(*[F.col("piece").alias(c) if c == text_col else F.length("piece").cast(docs.schema[c].dataType).alias(c) if c == chars_col
                         else columns([c], "row")[0] for c in docs.columns])
