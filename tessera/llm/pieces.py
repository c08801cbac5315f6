"""SentencePiece encoding and decoding with sampled segmentations.

A text's segmentations are the paths of a lattice over the model's pieces.  A
search in the order of perturbed log-probabilities (A* with Gumbel noise, top
down) emits the ``samples`` segmentations that a draw without replacement
would, with the probability that each is included.

A node of the search is a prefix of a path together with the edges already
taken after it; its bound is the largest Gumbel value among the paths below,
which is drawn from the mass below and the bound above it.  The best node's
path is found by walking the lattice by its edge probabilities, and every node
passed leaves one new search node for the edges not taken.

Pieces never reach over the start of a run of spaces or over a line end, so
the lattice is built once for each distinct unit between these places.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import wordhash as W
from tessera.llm.common import columns, own_name, plain

#: Path prefixes of lower log-probability hold less mass than a double resolves.
_NEGLIGIBLE = -40.0
_SLOTS = 20
#: An empty slot, and one that only beginnings of pieces fall into.
_NOTHING, _BEGIN = -1, -2
#: Factors that spread the spans' values over each table.
_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Bytes of a character at most.
_CHARACTER = 4
#: A lattice holds some eight arrays of its edges, so slices are small.
_SLICE_BYTES = 1 << 18


class Vocabulary:
    """Pieces of a SentencePiece model by the value of their bytes, a space for the space mark."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.bytes_of = [b""] * count
        self.byte_id = np.full(256, model.unk_id(), np.int32)
        ids, ranks = [], []
        for i in range(count):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = piece.replace("▁", " ").encode()
                if b" " in self.bytes_of[i].lstrip(b" ") or b"\n" in self.bytes_of[i]:
                    raise ValueError(f"piece {piece!r} reaches over a space or a line end")
                ids.append(i)
                ranks.append(min(max(-model.get_score(i), 0.0), float(count)))
        if (self.byte_id == model.unk_id()).any():
            raise ValueError("the model has no pieces for single bytes")
        raw = [self.bytes_of[i] for i in ids]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        self.ids = np.array(ids, np.int32)
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.cost = -sharpness * np.log(np.array(ranks) + 2.7)
        self.byte_cost = -sharpness * np.log(count + 2.7)
        starts = ends - np.diff(ends, prepend=0)
        sums, down = W.exact_sums(data), W.inverse_powers(len(data) + 1)
        self.values = W.span_values(sums[starts], sums[ends], down[starts], ends - starts)
        self.longest = int(np.diff(ends, prepend=0).max())
        # two tables of slots; a piece whose first slot is taken goes to the second
        self.slots = np.full((2, 1 << _SLOTS), _NOTHING, np.int32)
        one, two = self._places(self.values, 0).tolist(), self._places(self.values, 1).tolist()
        for j in range(len(ids)):
            if self.slots[0, one[j]] < 0:
                self.slots[0, one[j]] = j
            elif self.slots[1, two[j]] < 0:
                self.slots[1, two[j]] = j
            else:
                raise ValueError("too many pieces for the slots")
        # the first slots of all that pieces begin with tell where a longer one may still be found
        for length in range(1, self.longest):
            at = starts[ends - starts > length]
            place = self._places(W.span_values(sums[at], sums[at + length], down[at], length), 0)
            self.slots[0, place[self.slots[0, place] == _NOTHING]] = _BEGIN

    @staticmethod
    def _places(values: np.ndarray, table: int) -> np.ndarray:
        return ((values * _SPREAD[table]) >> np.uint64(64 - _SLOTS)).view(np.int64)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a piece may begin with each span (given by its value), the spans that are pieces, and which."""
        slot = self.slots[0, self._places(values, 0)]
        at = np.flatnonzero(slot >= 0)
        piece, own = slot[at], values[at]
        other = np.flatnonzero(self.values[piece] != own)
        piece[other] = self.slots[1, self._places(own[other], 1)]
        other = other[(piece[other] < 0) | (self.values[piece[other]] != own[other])]
        return slot != _NOTHING, np.delete(at, other), np.delete(piece, other)


@lru_cache(maxsize=2)
def vocabulary(path: str, sharpness: float) -> Vocabulary:
    return Vocabulary(path, sharpness)


class Lattice:
    """Edges of all distinct units, grouped by the byte where they start.

    For an edge: end byte (``next``: -1 for the unit's end), piece id (or -bytes
    for a character written as its bytes), probability among the edges of its
    start, and their running sum (endless at the last one).
    """

    def __init__(self, data: np.ndarray, unit_ends: np.ndarray, voc: Vocabulary):
        n = len(data)
        self.data = data
        char = (data & 0xC0) != 0x80
        stops = np.repeat(unit_ends, np.diff(unit_ends, prepend=0))  # end of the unit of each byte
        char[unit_ends[:-1]] = True
        if n:
            char[0] = True
        is_stop = np.append(char, True)
        sums = W.exact_sums(data)
        starts = np.flatnonzero(char)
        found = []
        single = np.zeros(n, bool)
        width = np.zeros(n, np.int64)
        width[starts] = np.append(starts[1:], n) - starts  # up to the next character
        # the live places are those where a piece may begin with the span that was looked up last
        live, room, begun, scale = starts, stops[starts] - starts, sums[starts], W.inverse_powers(n + 1)[starts]
        whole = bool(is_stop.all())
        for length in range(1, voc.longest + 1):
            if not len(live):
                break
            more, at, piece = voc.find(W.span_values(begun, sums[live + length], scale, length))
            at = live[at]
            if not whole:
                ends_char = is_stop[at + length]
                at, piece = at[ends_char], piece[ends_char]
            found.append((at, at + length, voc.ids[piece], voc.cost[piece]))
            if length <= _CHARACTER:
                single[at[width[at] == length]] = True
            more = np.flatnonzero(more & (room > length))
            live, room, begun, scale = live[more], room[more], begun[more], scale[more]
        bare = starts[~single[starts]]
        size = width[bare]
        ids = np.where(size == 1, voc.byte_id[data[bare]], -size.astype(np.int32))
        found.append((bare, bare + size, ids.astype(np.int32), voc.byte_cost * size))

        # places by their distance to the unit's end, nearest first; edges in that order
        distance = stops[starts] - starts
        order = np.argsort(distance.astype(np.uint16) if n < 65536 or distance.max(initial=0) < 65536 else distance, kind="stable")
        counts = np.zeros(n, np.int64)
        for at, *_ in found:
            counts[at] += 1
        places = starts[order]
        begin = np.concatenate([[0], np.cumsum(counts[places])])
        self.first = np.zeros(n + 1, np.int64)
        self.first[places] = begin[:-1]
        total = int(begin[-1])
        self.end = np.empty(total, np.int64)
        self.piece = np.empty(total, np.int32)
        cost = np.empty(total)
        fill = self.first.copy()
        for at, end, ids, c in found:
            to = fill[at]
            self.end[to], self.piece[to], cost[to] = end, ids, c
            fill[at] += 1
        self.last = fill - 1
        # mass of all paths from each place to its unit's end
        mass = np.zeros(n + 1)
        is_end = np.zeros(n + 1, bool)
        is_end[unit_ends] = True
        self.is_end = is_end
        self.next = np.where(is_end[self.end], -1, self.end)  # the last place's mass stays 0
        steps = np.flatnonzero(np.diff(distance[order], prepend=-1)) if len(order) else np.empty(0, np.int64)
        value = np.empty(total)
        for a, b in zip(steps, np.append(steps[1:], len(places))[:len(steps)], strict=True):
            lo, hi = begin[a], begin[b]
            np.add(cost[lo:hi], mass[self.next[lo:hi]], out=value[lo:hi])
            mass[places[a:b]] = np.logaddexp.reduceat(value[lo:hi], begin[a:b] - lo)
        many = counts[places]
        self.start = np.repeat(places, many)
        self.log = value - np.repeat(mass[places], many)
        self.share = np.exp(self.log)
        self.sums = np.cumsum(self.share)
        self.base = np.zeros(n + 1)
        self.base[places] = self.sums[begin[:-1]] - self.share[begin[:-1]] if total else 0.0
        self.sums[begin[1:] - 1] = np.inf  # no draw passes a place's last edge


def uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) fixed by the key and the parts."""
    for p in parts:
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.asarray(p).astype(np.uint64))
    return ((key >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def walk(lattice: Lattice, places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled edges from each place to its unit's end: (edges, number for each place)."""
    counts = np.zeros(len(places), np.int64)
    live, now, steps = np.arange(len(places)), places, []
    step = 0
    while len(live):
        target = lattice.base[now] + uniform(keys[live], step)
        edge = lattice.first[now]
        move = np.flatnonzero(lattice.sums[edge] < target)
        passed, target = edge[move], target[move]
        while len(move):
            passed += 1
            edge[move] = passed
            on = np.flatnonzero(lattice.sums[passed] < target)
            move, passed, target = move[on], passed[on], target[on]
        steps.append((live, edge))
        counts[live] += 1
        now = lattice.next[edge]
        go = np.flatnonzero(now >= 0)
        live, now = live[go], now[go]
        step += 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(offsets[-1]), np.int64)
    for k, (who, edge) in enumerate(steps):
        out[offsets[who] + k] = edge
    return out, counts


def gumbel_below(mass: np.ndarray, bound: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """Largest Gumbel value among paths of the given log-mass, known to be under ``bound``."""
    free = mass - np.log(-np.log(u))
    return -np.logaddexp(-bound, -free)


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each unit, and each text's first unit (one more at the end)."""
    n = len(data)
    start = np.zeros(n, bool)
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    if n > 1:
        start[1:] |= ((data[1:] == 32) & (data[:-1] != 32)) | (data[1:] == 10) | (data[:-1] == 10)
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space put before each one that is not empty."""
    some = np.diff(offsets) > 0
    shift = np.cumsum(some)
    out = np.full(len(data) + int(shift[-1]) if len(some) else 0, 32, np.uint8)
    doc = np.repeat(np.arange(len(some)), np.diff(offsets))
    out[np.arange(len(data)) + shift[doc]] = data
    return out, offsets + np.concatenate([[0], shift])


class Slice:
    """Sampled segmentations of a run of texts that share one lattice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, voc: Vocabulary):
        self.voc, self.keys = voc, keys
        self.data, self.offsets = with_space(data, offsets)
        starts, ends, self.first_unit = units_of(self.data, self.offsets)
        _, at, self.kind = np.unique(W.span_hashes(W.exact_sums(self.data), starts, ends), return_index=True, return_inverse=True)
        sizes = (ends - starts)[at]
        stops = np.cumsum(sizes)
        take = np.repeat(starts[at] - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)
        self.lattice = Lattice(self.data[take], stops, voc)
        self.places = (stops - sizes)[self.kind]
        doc = np.repeat(np.arange(len(keys)), np.diff(self.first_unit))
        self.unit_keys = W.mix(keys[doc] * np.uint64(0xD6E8FEB86659FD93) + (np.arange(len(doc)) - self.first_unit[doc]).astype(np.uint64))

    def rests(self, paths: list[tuple], turn: int, most: int) -> list[list[tuple[float, int]]]:
        """(bound, step) of the ``most`` best search nodes that each path leaves; paths: (text, edges, prefix, bound, first step)."""
        left, ends = [], []
        for _, edges, prefix, _, skip in paths:
            far = int(np.searchsorted(-prefix, -_NEGLIGIBLE, "right"))
            left.append(edges[skip:far])
            ends.append(prefix[skip:far])
        sizes = np.array([len(x) for x in left], np.int64)
        begin = np.cumsum(sizes) - sizes
        share = 1 - self.lattice.share[np.concatenate(left)]
        some = np.flatnonzero(share > 0)
        who = np.repeat(np.arange(len(paths)), sizes)[some]
        steps = some - (begin - np.array([p[4] for p in paths], np.int64))[who]
        key, bound = self.keys[np.array([p[0] for p in paths], np.int64)], np.array([p[3] for p in paths], np.float64)
        values = gumbel_below(np.concatenate(ends)[some] + np.log(share[some]), bound[who], uniform(key[who], np.uint64(7919 + turn), steps))
        out = []
        cuts = np.searchsorted(who, np.arange(len(paths) + 1)).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own, at = values[lo:hi], steps[lo:hi]
            if hi - lo > most:
                best = np.argpartition(own, -most)[-most:]
                own, at = own[best], at[best]
            out.append(list(zip(own.tolist(), at.tolist(), strict=True)))
        return out

    def sample(self, samples: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text, (edges, log-probability, perturbed log-probability, inclusion) in falling order."""
        lat, n = self.lattice, len(self.keys)
        heaps: list[list] = [[] for _ in range(n)]
        paths: list[list] = [[] for _ in range(n)]
        found: list[list] = [[] for _ in range(n)]
        tops = -np.log(-np.log(uniform(self.keys, np.uint64(1))))

        def add(turn: int, new: list[tuple[int, np.ndarray, np.ndarray, float, int]]) -> None:
            asked = []
            for i, edges, counts, top, skip in new:
                logs = lat.log[edges]
                ends = np.cumsum(logs)
                prefix = ends - logs
                asked.append((i, edges, prefix, top, skip))
                paths[i].append((edges, counts, prefix))
                found[i].append((edges, float(ends[-1]) if len(ends) else 0.0, top))
            for (i, *_), rests in zip(asked, self.rests(asked, turn, samples), strict=True):
                for value, step in rests:
                    heappush(heaps[i], (-value, turn, step, ()))

        edges, counts = walk(lat, self.places, self.unit_keys)
        bounds = np.concatenate([[0], np.cumsum(counts)])[self.first_unit]
        add(0, [(i, edges[bounds[i]: bounds[i + 1]], counts[self.first_unit[i]: self.first_unit[i + 1]], tops[i], 0) for i in range(n)])

        for turn in range(1, samples):
            asked, places, keys, others_of = [], [], [], []
            draws, falls = (uniform(self.keys, np.uint64(seed + turn)) for seed in (104729, 1299709))
            for i in range(n):
                if not heaps[i] or heaps[i][0][0] == np.inf:
                    continue
                value, which, step, done = heappop(heaps[i])
                old, old_counts, prefix = paths[i][which]
                place = lat.start[old[step]]
                done = (*(done or (int(old[step]),)),)
                others = np.array([e for e in range(lat.first[place], lat.last[place] + 1) if e not in done])
                shares = lat.share[others]
                sums = np.cumsum(shares)
                edge = int(others[min(int(np.searchsorted(sums, sums[-1] * draws[i])), len(others) - 1)])
                left = float(shares.sum() - lat.share[edge])
                if len(others) > 1 and left > 0:
                    others_of.append((i, which, step, (*done, edge), prefix[step], left, -value))
                unit = int(np.searchsorted(np.cumsum(old_counts), step, "right"))
                inside = step - int(old_counts[:unit].sum())
                rest = slice(self.first_unit[i] + unit + 1, self.first_unit[i + 1])
                part = not lat.is_end[lat.end[edge]]
                own = np.concatenate([[lat.end[edge]] if part else [], self.places[rest]]).astype(np.int64)
                places.append(own)
                keys.append(W.mix(self.unit_keys[slice(rest.start - part, rest.stop)] + np.uint64(15485863 * turn)))
                asked.append((i, old[:step], edge, old_counts[:unit], inside, part, -value, step))
            if not asked:
                break
            if others_of:
                mass = np.array([x[4] for x in others_of]) + np.log(np.array([x[5] for x in others_of]))
                below = gumbel_below(mass, np.array([x[6] for x in others_of]), falls[np.array([x[0] for x in others_of])])
                for (i, which, step, done, *_), bound in zip(others_of, below.tolist(), strict=True):
                    heappush(heaps[i], (-bound, which, step, done))
            edges, counts = walk(lat, np.concatenate(places), np.concatenate(keys))
            at_unit = at_edge = 0
            new = []
            for (i, head, edge, head_counts, inside, part, top, step), own in zip(asked, places, strict=True):
                mine = counts[at_unit: at_unit + len(own)]
                size = int(mine.sum())
                whole = np.concatenate([head, [edge], edges[at_edge: at_edge + size]]).astype(np.int64)
                first = inside + 1 + (int(mine[0]) if part else 0)
                new.append((i, whole, np.concatenate([head_counts, [first], mine[1:] if part else mine]).astype(np.int64), top, step + 1))
                at_unit += len(own)
                at_edge += size
            add(turn, new)
        out = []
        for i in range(n):
            least = -heaps[i][0][0] if heaps[i] else -np.inf
            out.append([(e, p, g, float(-np.expm1(-np.exp(min(p - least, 700.0)))) if least > -np.inf else 1.0) for e, p, g in found[i]])
        return out

    def ids(self, edges: np.ndarray) -> np.ndarray:
        piece = self.lattice.piece[edges]
        if not (piece < 0).any():
            return piece
        sizes = np.where(piece < 0, -piece, 1)
        out = np.repeat(piece, sizes)
        for at, edge in zip((np.cumsum(sizes) - sizes)[piece < 0], edges[piece < 0], strict=True):
            raw = self.lattice.data[self.lattice.start[edge]: self.lattice.end[edge]]
            out[at: at + len(raw)] = self.voc.byte_id[raw]
        return out


def decode_ids(ids: np.ndarray, voc: Vocabulary) -> bytes:
    """Text of a list of piece ids, without the space put before it."""
    sizes = voc.sizes[ids]
    ends = np.cumsum(sizes)
    raw = voc.raw[np.repeat(voc.begins[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
    return raw[1:] if raw[:1] == b" " else raw


def _encode(batches: Iterator[pa.RecordBatch], *, path: str, sharpness: float, samples: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns with (key, text) last, to all but these and the samples' columns."""
    voc = vocabulary(path, sharpness)
    for batch in batches:
        kept = batch.columns[:-2]
        keys = batch.column(batch.num_columns - 2).to_numpy().view(np.uint64)
        for lo, hi, data, offsets in W.slices(batch.column(batch.num_columns - 1), _SLICE_BYTES):
            part = Slice(data, offsets, W.mix(keys[lo:hi]), voc)
            rows, numbers, ids, logs, tops, shares, fine = [], [], [], [], [], [], []
            for i, found in enumerate(part.sample(samples)):
                text = data[offsets[i]: offsets[i + 1]].tobytes()
                for k, (edges, log, top, share) in enumerate(found):
                    own = part.ids(edges)
                    rows.append(lo + i)
                    numbers.append(k + 1)
                    ids.append(own)
                    logs.append(log)
                    tops.append(top)
                    shares.append(share)
                    fine.append(decode_ids(own, voc) == text)
            sizes = np.array([len(x) for x in ids], np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.astype(np.int32)))
            at = pa.array(np.array(rows, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*[c.take(at) for c in kept], pa.array(np.array(numbers, np.int32)), pa.array(sizes), lists, pa.array(np.array(logs)),
                 pa.array(np.array(tops)), pa.array(np.array(shares)), pa.array(np.array(fine, bool))], names=names)


def encoded(docs: DataFrame, model_path: str, *, samples: int = 2, sharpness: float = 1.0, keep: list[str] | None = None,
            text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``keep`` columns (default: all but the text) and, for each document and
    each of its up to ``samples`` distinct segmentations: sample (1, 2, ... by
    falling perturbed log-probability), n_pieces, piece_ids, log_prob,
    perturbed, inclusion (probability of being drawn, given the next value) and
    round_trip (whether the ids decode to the text).

    A path's probability is in proportion to the product of its pieces' weights,
    which fall with the piece's rank in the model by the power ``sharpness``.
    Noise is seeded by id and text, so repeated rows and reruns agree.  Null and
    empty texts have one segmentation without pieces; a text with fewer
    segmentations than asked gives them all, the last with inclusion 1.  Spaces,
    line ends and any characters come back unchanged: characters without a
    piece, the model's space mark among them, are written as bytes.  New columns
    take a longer name where the documents have theirs.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    fields = (("sample", T.IntegerType()), ("n_pieces", T.IntegerType()), ("piece_ids", T.ArrayType(T.IntegerType())), ("log_prob", T.DoubleType()),
              ("perturbed", T.DoubleType()), ("inclusion", T.DoubleType()), ("round_trip", T.BooleanType()))
    rows = docs.select(*columns(keep), F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias(own_name(docs, "row_key")),
                       F.coalesce(F.col(text_col), F.lit("")).alias(own_name(docs, "whole_text")))
    schema = T.StructType([*docs.select(*columns(keep)).schema.fields, *[T.StructField(own_name(docs, n), t) for n, t in fields]])
    return plain(rows).mapInArrow(partial(_encode, path=model_path, sharpness=sharpness, samples=samples, names=schema.names), schema)


def _decode(batches: Iterator[pa.RecordBatch], *, path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    voc = vocabulary(path, 1.0)
    for batch in batches:
        texts = [None if x is None else decode_ids(np.array(x, np.int64), voc).decode("utf-8", "replace") for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=names)


def decoded(rows: DataFrame, model_path: str, *, ids_col: str = "piece_ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the texts of their piece ids; a null list gives a null text."""
    name, ids = own_name(rows, text_col), own_name(rows, "ids")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    return rows.withColumn(ids, F.col(ids_col)).transform(plain).mapInArrow(partial(_decode, path=model_path, names=schema.names), schema)
