"""Substring dedup by super-k-mers.

A window is a run of ``window`` words.  Its minimiser is the smallest hash of
the runs of ``gram`` words in it, so neighbouring windows mostly share one:
the words under a run of such windows form a super-k-mer, which travels as one
packed string to the minimiser's bucket.  Equal windows have equal minimisers,
so they meet in one bucket, where sorting them counts each window exactly.

Buckets are many times the tasks and are told by the minimiser, and a task
packs its super-k-mers of one bucket into compressed blocks.  Minimisers that a
sample shows to be frequent would fill a bucket: their windows go one by one
instead, aggregated by their own words before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import wordhash as W
from tessera.llm.common import columns, own_name, stored

#: Share of rows whose minimisers are counted to find the frequent ones (results do not depend on it).
SAMPLE = 1 / 16
#: A minimiser is frequent from so many super-k-mers on, or from a 16th of a task's share of them.
LEAST_FREQUENT = 1000
#: Super-k-mers of one bucket hold about so many bytes.
BUCKET_BYTES = 4 << 20
#: Super-k-mers are cut after so many windows.
_LONGEST = 256
#: Texts of about so many bytes are packed together.
_BLOCK_BYTES = 16 << 20
#: Rows with covered words that are sent to every task; beyond, the texts are shuffled to them.
SENT_SPANS = 1_000_000
_COMPARED = 1 << 14

_ZSTD = pa.Codec("zstd", compression_level=5)
_WINDOW = "doc_id long, copy int, first int, words binary"
_SPAN = "doc_id long, copy int, first int, last int"


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with one space between the words of a text, then each word's
    start and end in them, and each text's first word (one more at the end)."""
    starts, ends, first = W.word_bounds(data, offsets, W.BY_SPACE)
    keep = W.BY_SPACE[data]
    owner_last = np.zeros(len(starts), bool)
    owner_last[first[1:][first[1:] > first[:-1]] - 1] = True
    gaps = ends[~owner_last]
    out = data.copy()
    out[gaps] = 32
    keep[gaps] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], place[starts], place[ends], first


def minimisers(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a window of its text starts at each word, and the minimiser of each such window."""
    n = len(hashes)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    grams = W.grams(hashes, gram)
    low = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    count = n - window + 1
    if count > 0:
        low[:count] = grams[:count]
        for k in range(1, window - gram + 1):
            np.minimum(low[:count], grams[k: k + count], out=low[:count])
    return room >= window, low


def runs(valid: np.ndarray, key: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of windows with one key, ``longest`` at most."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (key[at[1:]] != key[at[:-1]])
    begin = np.flatnonzero(fresh)
    since = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(since % longest == 0)
    return at[begin], at[np.append(begin[1:], len(at)) - 1]


def cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of the bytes as a binary array."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[take])])


def _windows(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[tuple]:
    """For slices of (doc_id, copy, text): bytes, word starts and ends, first words, row of each word, valid windows, minimisers."""
    for lo, hi, data, offsets in W.slices(batch.column(2)):
        text, starts, ends, first = spaced(data, offsets)
        if not len(starts):
            continue
        hashes = W.span_hashes(W.exact_sums(text), starts, ends)
        valid, low = minimisers(hashes, first, window, gram)
        yield text, starts, ends, np.repeat(np.arange(lo, hi), np.diff(first)), first, valid, low


def _frequencies(batches: Iterator[pa.RecordBatch], *, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Minimiser of each super-k-mer."""
    for batch in batches:
        for *_, first, valid, low in _windows(batch, window, gram):
            begin, _ = runs(valid, low, _LONGEST)
            yield pa.RecordBatch.from_arrays([pa.array(low[begin].view(np.int64))], names=["key"])


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def block_of(ids: np.ndarray, copies: np.ndarray, places: np.ndarray, words: list[np.ndarray]) -> tuple[int, bytes]:
    """Size and compressed bytes of some super-k-mers."""
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    # ids as differences: those of one task mostly rise
    raw = b"".join([np.int32(len(ids)).tobytes(), np.diff(ids.astype(np.int64), prepend=np.int64(0)).tobytes(), copies.astype(np.int32).tobytes(),
                    places.astype(np.int32).tobytes(), sizes.tobytes(), *[w.tobytes() for w in words]])
    return len(raw), _ZSTD.compress(raw).to_pybytes()


def super_kmers(size: int, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, copies, places, sizes, bytes) of a block."""
    raw = np.frombuffer(_ZSTD.decompress(block, size), np.uint8)
    n, at, out = int(raw[:4].view(np.int32)[0]), 4, []
    for kind in (np.int64, np.int32, np.int32, np.int32):
        width = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at: at + width].tobytes(), kind))
        at += width
    return (np.cumsum(out[0]), *out[1:], raw[at:])


def _send(batches: Iterator[pa.RecordBatch], *, window: int, gram: int, frequent: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, copy, text) to (bucket, size, block): the super-k-mers of a bucket, compressed."""
    def emitted(held: list) -> pa.RecordBatch:
        ids, copies, places, to = (np.concatenate([h[i] for h in held]) for i in range(4))
        words = [w for h in held for w in h[4]]
        order = np.argsort(to, kind="stable")
        at = np.append(np.flatnonzero(np.append(True, np.diff(to[order]) != 0)), len(order))
        blocks = [block_of(ids[own], copies[own], places[own], [words[k] for k in own]) for own in (order[a:b] for a, b in zip(at[:-1], at[1:], strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(to[order[at[:-1]]].astype(np.int32)), pa.array([n for n, _ in blocks], pa.int32()),
                                           pa.array([b for _, b in blocks], pa.binary())], names=["bucket", "size", "block"])

    held, size = [], 0
    for batch in batches:
        ids, copies = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for text, starts, ends, row, first, valid, low in _windows(batch, window, gram):
            begin, end = runs(valid & ~_is_in(low, frequent), low, _LONGEST)
            if len(begin):
                held.append((ids[row[begin]], copies[row[begin]], _within(begin, first), (W.mix(low[begin]) % np.uint64(buckets)).astype(np.int64),
                             [text[a:b] for a, b in zip(starts[begin].tolist(), ends[end + window - 1].tolist(), strict=True)]))
                size += len(text)
            if size >= _BLOCK_BYTES:
                yield emitted(held)
                held, size = [], 0
    if held:
        yield emitted(held)


def _within(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of each word in its own text."""
    return at - first[np.searchsorted(first, at, "right") - 1]


def _spans(owner: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of one owner: (owner, first word, word after the last)."""
    fresh = np.ones(len(place), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(fresh)
    last = np.append(begin, len(place))[1:] - 1
    return owner[begin], place[begin], place[last] + window


def same_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each window, equal for windows of the same words only.

    Windows are sorted by hash; those of one hash are compared byte by byte
    with the first of them, and told apart by their words if any differs.
    """
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])
    group = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    head = order[begin][group]
    sizes = ends[order] - starts[order]
    bad = sizes != ends[head] - starts[head]
    later = np.flatnonzero(~fresh & ~bad)
    for lo in range(0, len(later), _COMPARED):
        some = later[lo: lo + _COMPARED]
        offsets = np.concatenate([[0], np.cumsum(sizes[some])])
        step = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes[some])
        differ = data[np.repeat(starts[order[some]], sizes[some]) + step] != data[np.repeat(starts[head[some]], sizes[some]) + step]
        bad[some] = np.add.reduceat(differ, offsets[:-1]) > 0
    out = np.empty(len(order), np.int64)
    out[order] = group
    for g in np.unique(group[bad]):  # a hash shared by different words
        own = order[begin[g]: begin[g + 1] if g + 1 < len(begin) else len(order)]
        named: dict[bytes, int] = {}
        for w in own:
            out[w] = len(order) + int(named.setdefault(data[starts[w]: ends[w]].tobytes(), w))
    return out


def _count(batches: Iterator[pa.RecordBatch], *, window: int) -> Iterator[pa.RecordBatch]:
    """(bucket, size, block), all of a bucket in a row, to the spans of words that an earlier document's windows cover."""
    def counted(blocks: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ids, copies, places, sizes, data = (np.concatenate(x) for x in zip(*[super_kmers(*b) for b in blocks], strict=True))
        offsets = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        starts, ends, first = W.word_bounds(data, offsets, W.BY_SPACE)
        hashes = W.grams(W.span_hashes(W.exact_sums(data), starts, ends), window)
        held = np.diff(first)
        row = np.repeat(np.arange(len(ids)), held)
        at = np.flatnonzero(np.repeat(first[1:], held) - np.arange(len(starts)) >= window)
        row = row[at]
        same = same_windows(data, starts[at], ends[at + window - 1], hashes[at])
        order = np.argsort(same, kind="stable")
        ranked = same[order]
        begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        least = np.empty(len(at), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[row[order]], begin), np.diff(np.append(begin, len(at))))
        late = ids[row] > least
        owner, lo, hi = _spans(row[late], (at - first[row] + places[row])[late], window)
        return pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(copies[owner]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                                          names=["doc_id", "copy", "first", "last"])

    now, held = None, []
    for batch in batches:
        for bucket, size, block in zip(*[batch.column(k) for k in range(3)], strict=True):
            if bucket.as_py() != now and held:
                yield counted(held)
                held = []
            now = bucket.as_py()
            held.append((size.as_py(), block.as_py()))
    if held:
        yield counted(held)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, copy, spans) with the overlapping and touching spans of each row made one."""
    for batch in batches:
        out = []
        for row in batch.column(2):
            first, last = (np.array(row.values.field(k)) for k in (0, 1))
            order = np.argsort(first, kind="stable")
            first, reach = first[order], np.maximum.accumulate(last[order])
            begin = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
            out.append([{"first": int(a), "last": int(b)} for a, b in zip(first[begin], reach[np.append(begin[1:], len(first)) - 1], strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, batch.column(2).type)], names=["doc_id", "copy", "spans"])


def _alone(batches: Iterator[pa.RecordBatch], *, window: int, gram: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, copy, text) to (doc_id, copy, first, words) of every window with a frequent minimiser."""
    for batch in batches:
        ids, copies = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for text, starts, ends, row, first, valid, low in _windows(batch, window, gram):
            at = np.flatnonzero(valid & _is_in(low, frequent))
            if len(at):
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[row[at]]), pa.array(copies[row[at]].astype(np.int32)), pa.array(_within(at, first).astype(np.int32)),
                    cut_out(text, starts[at], ends[at + window - 1])], names=["doc_id", "copy", "first", "words"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, spans) to (row, n_words, n_removed, kept): the words outside the spans, joined by one space."""
    for batch in batches:
        counts, gone, kept = [], [], []
        spans = batch.column(2)
        for lo, hi, data, offsets in W.slices(batch.column(1)):
            text, starts, ends, first = spaced(data, offsets)
            for i in range(lo, hi):
                a, b = first[i - lo], first[i - lo + 1]
                own = spans[i].as_py()
                counts.append(int(b - a))
                if not own:
                    gone.append(0)
                    kept.append(text[starts[a]: ends[b - 1]].tobytes() if b > a else b"")
                    continue
                edge = np.zeros(b - a + 1, np.int64)
                for s in own:
                    edge[s["first"]] += 1
                    edge[s["last"]] -= 1
                stays = np.cumsum(edge[:-1]) == 0
                gone.append(int(len(stays) - stays.sum()))
                fresh = np.diff(np.concatenate([[0], stays.astype(np.int8), [0]]))
                kept.append(b" ".join(text[starts[a + x]: ends[a + y - 1]].tobytes() for x, y in zip(np.flatnonzero(fresh == 1), np.flatnonzero(fresh == -1), strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                                          pa.array([k.decode() for k in kept], pa.string())], names=["row", "n_words", "n_removed", "kept"])


def covered_spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, copy, spans): the runs of words of each (doc_id, copy, text)
    that are covered by windows which also start in a smaller doc_id."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # a window starts at each word of some seven bytes, and some six share a super-k-mer
    limit = max(LEAST_FREQUENT, size // 42 // (16 * tasks))
    counts = docs.sample(SAMPLE, 5).mapInArrow(partial(_frequencies, window=window, gram=gram), "key long").groupBy("key").agg(F.count("*").alias("n"))
    keys = [r["key"] for r in counts.where(F.col("n") >= limit * SAMPLE).select("key").collect()]  # some 16 a task at most
    frequent = np.sort(np.array(keys, np.int64).view(np.uint64))

    buckets = max(4 * tasks, 3 * size // BUCKET_BYTES)
    sent = docs.mapInArrow(partial(_send, window=window, gram=gram, frequent=frequent, buckets=buckets), "bucket int, size int, block binary")
    spans = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_count, window=window), _SPAN)
    if len(frequent):
        alone = docs.mapInArrow(partial(_alone, window=window, gram=gram, frequent=frequent), _WINDOW)
        salts = 16
        least = alone.groupBy("words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most") \
            .select("words", "least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        late = alone.withColumn("salt", F.pmod(F.xxhash64("doc_id", "first"), F.lit(salts)).cast("int")).join(least, ["words", "salt"]).where("doc_id > least")
        spans = spans.union(late.select("doc_id", "copy", "first", (F.col("first") + window).alias("last")))
    held = spans.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return held.mapInArrow(_merged, "doc_id long, copy int, spans array<struct<first:int,last:int>>")


def text_copy(text: Column) -> Column:
    """Tells texts under one doc_id apart."""
    return F.hash(F.coalesce(text, F.lit("")))


def without_copied(docs: DataFrame, *, window: int = 13, gram: int = 3, id_col: str = "doc_id", text_col: str = "text",
                   keep: list[str] | None = None) -> DataFrame:
    """Every row's ``keep`` columns (default: all) with n_words, n_removed and
    kept: its text without the words of windows that also start in a document
    with a smaller id, words joined by one space.

    A window is ``window`` words in a row, judged on the input as it was.
    Null texts are empty; texts with fewer words lose nothing.  Windows within
    one document, or in rows with one id, do not count against each other;
    rows with a null id are neither earlier nor later than others and lose
    nothing.  Repeated rows lose the same words.  New columns take a longer
    name where the rows have theirs; no rows give no rows.
    """
    keep = docs.columns if keep is None else keep
    ident, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = docs.select(ident.alias("doc_id"), text_copy(text).alias("copy"), text.alias("text")).where("doc_id is not null")
    spans = stored(covered_spans(slim, window, gram))
    held = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    spans = spans.select("doc_id", F.col("copy").alias("c"), "spans")
    spans = F.broadcast(spans) if held <= SENT_SPANS else spans
    kept_columns = docs.select(*columns(keep))
    rows = docs.select(F.struct(*columns(keep)).alias("row"), ident.alias("id"), text_copy(text).alias("copy"), text.alias("text"))
    rows = rows.join(spans, (F.col("id") == F.col("doc_id")) & (F.col("copy") == F.col("c")), "left").select("row", "text", "spans")
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    found = rows.mapInArrow(_kept, schema)
    names = {c: own_name(kept_columns, c) for c in ("n_words", "n_removed", "kept")}
    return found.select("row.*", *[F.col(c).alias(n) for c, n in names.items()])
