"""MinHash near-dedup by min-max hashing.

Every shingle is hashed once under each permutation and both the smallest and
the largest value are kept, so ``2 * n_hashes`` signature values cost
``n_hashes`` evaluations.  The values are cut into bands; texts that agree on
a whole band are candidates, and candidates are confirmed on their full
shingle sets.  With 256 permutations in bands of 8 values a pair at similarity
0.8 meets in at least one of 64 bands with probability 1 - 7.7e-6, while a
pair at 0.2 meets with probability 1.6e-4.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import wordhash as W
from tessera.llm.common import SPACE, columns, own_name, stored
from tessera.llm.components import connected_components

_STEP_SHINGLES = 2048
#: Classes that are sent to every task to fetch their signatures or texts; more are joined by shuffling these.
SENT_CLASSES = 1_000_000
#: Pairs of one class that are confirmed by one task.
HUB_PAIRS = 2000
#: Permutations of the finer sketch, one bit of each minimum and maximum.
FINE_HASHES = 2048


def _permutations(n_hashes: int) -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32) | np.uint32(1)


def min_max(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest, then largest value of a shingle set under each permutation."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    high = np.zeros(len(factors), np.uint32)
    for at in range(0, len(folded), _STEP_SHINGLES):
        values = factors[:, None] * folded[None, at: at + _STEP_SHINGLES]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` signature values."""
    bands = signature.astype(np.uint64).reshape(-1, rows)
    keys = np.arange(len(bands), dtype=np.uint64)
    for k in range(rows):
        keys = W.mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
    return keys


def sketch(signature: np.ndarray) -> np.ndarray:
    """Two hashed bits of each signature value, 32 values to a long."""
    bits = ((signature * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64).reshape(-1, 32)
    return (bits << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _fine(batches: Iterator[pa.RecordBatch], *, words: int) -> Iterator[pa.RecordBatch]:
    """(cid, text) to (cid, fine): one bit of each of many more signature values, 64 to a long."""
    factors = np.random.default_rng(20240301).integers(0, 1 << 32, FINE_HASHES, dtype=np.uint32) | np.uint32(1)
    for batch in batches:
        out = []
        for lo, hi, data, offsets in W.slices(batch.column(1)):
            hashes, first = W.word_hashes(data, offsets)
            for i in range(hi - lo):
                signature = min_max(W.shingle_set(hashes[first[i]: first[i + 1]], words), factors)
                bits = ((signature * np.uint32(0x85EBCA6B)) >> np.uint32(31)).astype(np.uint8)
                out.append(np.packbits(bits).view(np.int64))
        width = 2 * FINE_HASHES // 64
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * np.int32(width)), pa.array(np.concatenate([np.empty(0, np.int64), *out])))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["cid", "fine"])


def fine_agreement(a: Column, b: Column) -> Column:
    """Share of the finer sketch's bits on which two texts agree."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return 1 - apart / (2 * FINE_HASHES)


def least_fine(share: tuple[int, int]) -> float:
    """Bits that agree between texts at the threshold, less four standard errors."""
    agree = (1 + share[0] / share[1]) / 2
    return agree - 4 * math.sqrt(agree * (1 - agree) / (2 * FINE_HASHES))


def least_agreement(share: tuple[int, int], values: int) -> int:
    """Sketch values that agree between texts at the threshold, less four standard errors."""
    alike = share[0] / share[1]
    agree = alike + (1 - alike) / 4
    return math.floor(values * agree - 4 * math.sqrt(values * agree * (1 - agree)))


def agreement(a: Column, b: Column, longs: int) -> Column:
    """Sketch values on which two texts agree."""
    odd = F.lit(0x5555555555555555)
    apart = F.lit(0)
    for i in range(longs):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
    return 32 * longs - apart


def _sign(batches: Iterator[pa.RecordBatch], *, words: int, n_hashes: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, th, text) to (rid, doc_id, th, n_shingles, fp1, fp2, bands, sketch)."""
    factors = _permutations(n_hashes)
    per_doc, per_sketch = 2 * n_hashes // rows, 2 * n_hashes // 32
    for batch in batches:
        texts = batch.column(3)
        counts = np.zeros(len(texts), np.int64)
        prints = np.zeros((2, len(texts)), np.uint64)
        keys, sketches, some = [], [], np.zeros(len(texts) + 1, np.int32)
        for lo, hi, data, offsets in W.slices(texts):
            hashes, first = W.word_hashes(data, offsets)
            for i in range(lo, hi):
                found = W.shingle_set(hashes[first[i - lo]: first[i - lo + 1]], words)
                if not len(found):
                    continue
                counts[i] = len(found)
                prints[0, i] = W.mix(found + np.uint64(1)).sum(dtype=np.uint64)
                prints[1, i] = np.bitwise_xor.reduce(W.mix(found * np.uint64(3)))
                signature = min_max(found, factors)
                keys.append(band_keys(signature, rows))
                sketches.append(sketch(signature))
                some[i + 1] = 1
        at = np.cumsum(some, dtype=np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at * np.int32(size)), pa.array(np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64)))
                 for own, size in ((keys, per_doc), (sketches, per_sketch))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(counts),
             pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), *lists],
            names=["rid", "doc_id", "th", "n_shingles", "fp1", "fp2", "bands", "sketch"])


def _confirm(batches: Iterator[pa.RecordBatch], *, words: int, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the (a, b) whose full sets overlap enough."""
    for batch in batches:
        sets = []
        for k in (2, 3):
            own = []
            for lo, hi, data, offsets in W.slices(batch.column(k)):
                hashes, first = W.word_hashes(data, offsets)
                own += [W.shingle_set(hashes[first[i]: first[i + 1]], words) for i in range(hi - lo)]
            sets.append(own)
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(*sets, strict=True)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = len(x) > 0 and share[1] * both >= share[0] * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, *, words: int = 5, share: tuple[int, int] = (80, 100), n_hashes: int = 256,
                    rows: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, th (64-bit hash of the text), n_shingles,
    component_id (smallest doc_id its links reach), kept (it is that document)
    and stays (true on exactly one row of each component).

    Two texts are linked if ``share[1] * |intersection| >= share[0] * |union|``
    of their distinct shingles of ``words`` words.

    1. One pass over the texts gives each row its set size, a 128-bit
       fingerprint of the set and its band keys; texts and shingles are not
       shuffled.
    2. Rows with equal sets form a class; only classes go on, so copies are
       never paired with one another.
    3. In each band bucket every class is compared with the bucket's smallest
       class, if their set sizes allow a link.  Confirmed links are joined into
       components.
    4. In buckets that still hold several components, the classes outside the
       largest one are compared with those of other components, each pair in
       the first band it shares, if their set sizes allow a link and their
       signatures, and then their finer ones of eight times the values, agree
       about as often as two texts at the threshold do (less four standard
       errors).  So every candidate pair is confirmed, refuted or inside one
       component.

    Null texts are empty.  Rows without words have no shingles, link with
    nothing, and keep their own doc_id.  Rows with a null doc_id take part by
    their text; a component of such rows alone has a null component_id and
    kept is false, but one row of it still has stays = true.  Repeated rows
    are copies like any others.  Extra columns are ignored.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
                       text_key(F.col(text_col)).alias("th"), F.coalesce(text_col, F.lit("")).alias("text"))
    signed = stored(slim.mapInArrow(partial(_sign, words=words, n_hashes=n_hashes, rows=rows),
                                    "rid long, doc_id long, th long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch array<long>"))
    classes = stored(signed.where("n_shingles > 0").groupBy("fp1", "fp2").agg(
        F.min("rid").alias("cid"), F.min("doc_id").alias("rep"),
        F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))).alias("lead")))

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= SENT_CLASSES else df

    def sizes_fit(n: Column, m: Column) -> Column:
        return share[1] * F.least(n, m) >= share[0] * F.greatest(n, m)

    # a class has a row here for each band, so the rows are flat, and dealt once for the buckets' hubs and for the join with them
    posts = signed.join(sent(classes.select("cid")), signed["rid"] == F.col("cid")).select("cid", "n_shingles", F.explode("bands").alias("bucket")).repartition("bucket")
    shared = posts.groupBy("bucket").agg(F.min("cid").alias("hub"), F.min_by("n_shingles", "cid").alias("hub_n"), F.max("cid").alias("last")).where("hub < last")
    posts = stored(posts.join(shared.drop("last"), "bucket"))

    candidates = sent(stored(posts.select("cid").distinct()))
    asked = sent(stored(signed.join(candidates, signed["rid"] == F.col("cid")).select("cid", "doc_id", "th")))
    whole = docs.select(F.col(id_col).cast("long").alias("i"), text_key(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    texts = stored(whole.join(asked, (F.col("t") == F.col("th")) & F.col("i").eqNullSafe(F.col("doc_id")))
                   .select("cid", "text").dropDuplicates(["cid"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Each class ``a`` goes to as many tasks as its pairs need."""
        one, two = (texts.select(F.col("cid").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).alias("tasks"))
        one = one.join(tasks, "a").select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"))
        dealt = pairs.join(tasks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "tasks").alias("task"))
        return stored(dealt.join(two, "b").join(one, ["a", "task"]).select("a", "b", "text_a", "text_b")
                      .mapInArrow(partial(_confirm, words=words, share=share), "a long, b long"))

    first = stored(posts.where("hub < cid").where(sizes_fit(F.col("n_shingles"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct())
    links = confirmed(first)
    comps = stored(connected_components(links))

    placed = posts.join(comps.withColumnRenamed("node", "cid"), "cid", "left").select(
        "bucket", "cid", "n_shingles", F.coalesce("component", "cid").alias("comp"))
    mixed = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    placed = placed.join(mixed.select("bucket", F.col("top.comp").alias("main")), "bucket")
    fine = texts.join(placed.select("cid").distinct(), "cid").select("cid", "text").mapInArrow(partial(_fine, words=words), "cid long, fine array<long>")
    traits = signed.join(candidates, signed["rid"] == F.col("cid")).select("cid", "bands", "sketch").join(fine, "cid")
    placed = stored(placed.join(traits, "cid").withColumn("band", F.array_position("bands", F.col("bucket")).cast("int") - 1))
    left = placed.where("comp <> main").select("bucket", *[F.col(c).alias("l_" + c) for c in ("cid", "comp", "n_shingles", "bands", "sketch", "fine")])
    earlier = F.exists(F.sequence(F.lit(0), F.col("band")), lambda i: (i < F.col("band")) & (F.get("bands", i) == F.get("l_bands", i)))
    # stored: what is confirmed is planned three times
    second = stored(left.join(placed, (left["bucket"] == placed["bucket"]) & (F.col("comp") != F.col("l_comp"))
                              & ((F.col("comp") == F.col("main")) | (F.col("l_cid") < F.col("cid")))
                              & sizes_fit(F.col("l_n_shingles"), F.col("n_shingles")) & (agreement(F.col("l_sketch"), F.col("sketch"), 2 * n_hashes // 32) >= least_agreement(share, 2 * n_hashes)) & ~earlier
                              & (fine_agreement(F.col("l_fine"), F.col("fine")) >= least_fine(share))) \
        .select(F.least("cid", "l_cid").alias("a"), F.greatest("cid", "l_cid").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    more = confirmed(second)
    # links between components, told by the components' ids, join the first components
    named = comps.withColumnRenamed("node", "n")
    lifted = more
    for c in "ab":
        lifted = lifted.join(named.select(F.col("n").alias(c), F.col("component").alias(f"comp_{c}")), c, "left")
    lifted = lifted.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).distinct()
    above = connected_components(lifted).select(F.col("node").alias("comp"), F.col("component").alias("top"))

    tops = stored(classes.join(comps.withColumnRenamed("node", "cid"), "cid", "left") \
        .withColumn("comp", F.coalesce("component", "cid")).join(above, "comp", "left") \
        .select("fp1", "fp2", "rep", "lead", F.coalesce("top", "comp").alias("top")))
    heads = tops.groupBy("top").agg(F.min("rep").alias("component_id"), F.min("lead").alias("lead"))
    named_classes = tops.join(heads.withColumnRenamed("lead", "first_row"), "top").select("fp1", "fp2", "component_id", F.col("first_row.r").alias("keeper"))

    rows_ = signed.select("rid", "doc_id", "th", "n_shingles", "fp1", "fp2")
    out = rows_.where("n_shingles > 0").join(named_classes, ["fp1", "fp2"]).select(
        "doc_id", "th", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), (F.col("rid") == F.col("keeper")).alias("stays"))
    alone = rows_.where("n_shingles = 0").select(
        "doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").isNotNull().alias("kept"), F.lit(True).alias("stays"))
    return out.union(alone)


def deduplicated(docs: DataFrame, **params) -> DataFrame:
    """The documents without near copies: one row of each component stays,
    with all its columns; rows without words all stay."""
    text = params.get("text_col", "text")
    ident = params.get("id_col", "doc_id")
    i, t = own_name(docs, "kept_i"), own_name(docs, "kept_t")
    keep = near_duplicates(docs, **params).where("stays and n_shingles > 0").select(
        F.col("doc_id").alias(i), F.col("th").alias(t))
    blank = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE)) == ""
    keyed = docs.where(~blank).withColumn(t, text_key(F.col(text)))
    found = keyed.join(keep, [t]).where(F.col(ident).cast("long").eqNullSafe(F.col(i)))
    one = found.dropDuplicates([t]).select(*columns(docs.columns))
    return one.union(docs.where(blank))
