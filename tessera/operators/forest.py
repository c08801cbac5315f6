"""Random-forest classification of sparse rows, grown where the rows are.

Each tree draws its rows with replacement (Poisson(1) weights) and each node
draws ceil(sqrt(F)) features; splits are by Gini gain, down to ``max_depth``.

Scale notes
-----------
* Values are binned once (zero, and up to 31 bins of the values above it) and
  kept as one bit per feature and one byte per value that is not zero.  A node
  tests its features' bits; only values that are there are counted.
* While a node's rows weigh more than ``LOCAL_BYTES``, they stay where they
  are: one job a level counts bins by node, and the splits (a few numbers a
  node) are chosen from the sums.  A lighter node's rows are sent to one task,
  which grows all that is below it; if all rows are light together, a task grows
  some whole trees.  No task holds more, however large the input is.
* Rows without weight of their own (the test rows) go along, and each leaf
  adds its class shares to theirs: the trees are never gathered.
* A node's features follow from (seed, tree, node), a row's weight from
  (seed, tree, row): the forest is the same however its rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, tracked

#: Bytes of rows, as they lie in a task, that are grown in one task.
LOCAL_BYTES = 320 << 20
#: Rows of a block as it is kept and sent.
BLOCK_ROWS = 8_192
#: Bins of a feature: zero, and quantiles of the values above it.
BINS = 32
#: Rows from which the quantiles are taken, as many as Spark's own trees take.
QUANTILE_ROWS = 10_000
#: Levels whose splits are passed anew by each job before the rows' nodes are stored.
KEPT_LEVELS = 5
#: Shares are summed as whole numbers, so that their order does not matter.
SHARE = 1 << 40
#: Rows whose features are tested together.
STEP_ROWS = 4_096

_M64 = (1 << 64) - 1


# ------------------------------------------------------------- draws
def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash (splitmix64) of each number."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(*parts: int) -> np.uint64:
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = _mixed(x ^ np.uint64(p & _M64))
    return x[0]


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])[:15]


def weights(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often a tree draws each row (Poisson(1), at most 15)."""
    u = (_mixed(rows.astype(np.uint64) ^ _salt(seed, tree, 1)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
    return np.searchsorted(_POISSON, u, side="right").astype(np.uint8)


def _prime(n: int) -> int:
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def drawn_features(seed: int, tree: int, nodes: np.ndarray, n_features: int) -> np.ndarray:
    """(node, ceil(sqrt(n_features))) different features of each node: a random line modulo a
    prime over shuffled features, so that any two are as likely together as any others."""
    m, p = math.isqrt(n_features - 1) + 1, _prime(n_features)
    order = np.random.default_rng([seed, tree]).permutation(n_features).astype(np.int32)
    h = _mixed(nodes.astype(np.uint64) ^ _salt(seed, tree, 2))
    step = (h % np.uint64(p - 1)).astype(np.int64) + 1
    first = ((h >> np.uint64(32)) % np.uint64(p)).astype(np.int64)
    at = (step[:, None] * np.arange(m + p - n_features) + first[:, None]) % p
    out = at[:, :m]
    odd = np.flatnonzero((out >= n_features).any(axis=1))
    if len(odd):
        keep = np.argsort(at[odd] >= n_features, axis=1, kind="stable")[:, :m]
        out[odd] = np.take_along_axis(at[odd], keep, axis=1)
    return order[out]


# ------------------------------------------------------------- rows
def thresholds(features: np.ndarray, values: np.ndarray, n_features: int) -> np.ndarray:
    """(feature, BINS - 2) rising bounds between bins of the values above zero (inf: none)."""
    by = np.lexsort((values, features))
    values = values[by]
    n = np.bincount(features, minlength=n_features)
    start = np.cumsum(n) - n
    at = start[:, None] + n[:, None] * np.arange(1, BINS - 1) // (BINS - 1)
    inner = (at > start[:, None]) & (n[:, None] > 1)
    low, high = (values[np.where(inner, at + k, 0)] if len(values) else np.zeros(at.shape) for k in (-1, 0))
    return np.sort(np.where(inner & (low < high), (low + high) / 2, np.inf), axis=1)


def binned(features: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bin (1 to BINS - 1) of each value above zero."""
    out = np.empty(len(values), np.uint8)
    for i in range(0, len(values), 1 << 18):
        part = slice(i, i + (1 << 18))
        out[part] = 1 + (values[part, None] > bounds[features[part]]).sum(axis=1)
    return out


def _words(n_features: int) -> int:
    return -(-n_features // 64)


def packed(at: np.ndarray) -> bytes:
    """Rising numbers as differences in bytes; 255 adds up with what follows."""
    d = np.diff(at, prepend=0)
    more = d // 255
    out = np.full(len(d) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = d - 255 * more
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return np.cumsum(b, dtype=np.int64)[b != 255]


class Rows:
    """Binned rows: a bit for each feature above zero and, in order, the bins of those."""

    def __init__(self, n_features: int, blocks: list[tuple[int, bytes, bytes]]):
        """blocks: number of rows, packed positions (row * 64 * words + feature), bins.  The list is used up."""
        self.w = w = _words(n_features)
        self.n = n = sum(x[0] for x in blocks)
        self.bits, bins = np.zeros(n * w, np.uint64), []
        self.before, self.start = np.empty(n * w, np.uint16), np.empty(n, np.int64)
        self.octets, row, values = self.bits.view(np.uint8), 0, 0
        while blocks:
            k, at, own = blocks.pop(0)
            bins.append(np.frombuffer(own, np.uint8))
            p = unpacked(at)
            part, octets = slice(row * w, (row + k) * w), self.octets[row * w * 8 : (row + k) * w * 8]
            if len(p):
                byte = p >> 3
                new = np.flatnonzero(np.diff(byte, prepend=-1))
                octets[byte[new]] = np.bitwise_or.reduceat(np.left_shift(1, p & 7).astype(np.uint8), new)
            count = np.bitwise_count(self.bits[part]).reshape(k, w)
            up = np.cumsum(count, axis=1, dtype=np.uint16)
            self.before[part] = (up - count).ravel()
            total = up[:, -1].astype(np.int64)
            self.start[row : row + k] = values + np.cumsum(total) - total
            row, values = row + k, values + len(own)
        self.bins = np.concatenate(bins) if bins else np.zeros(0, np.uint8)

    def bin(self, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Bin of each (row, feature), 0 for a value of zero."""
        at = row * self.w + (feature >> 6)
        word, bit = self.bits[at], (feature & 63).astype(np.uint64)
        rank = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        there = ((word >> bit) & np.uint64(1)).astype(bool)
        out = np.zeros(len(row), np.uint8)
        hit = np.flatnonzero(there)
        out[hit] = self.bins[self.start[row[hit]] + self.before[at[hit]] + rank[hit]]
        return out


# ------------------------------------------------------------- splits
def tallied(rows: Rows, row: np.ndarray, node: np.ndarray, label: np.ndarray, weight: np.ndarray,
            features: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by class of each (node, drawn feature, bin above 0), as rising codes and counts.
    ``row`` rises, so that the rows' bits are read in their order."""
    m, found = features.shape[1], [np.zeros(0, np.int64)]
    octet, mask = (features >> 3).astype(np.int32), np.left_shift(1, features & 7).astype(np.uint8)
    for i in range(0, len(row), STEP_ROWS):
        r, k = row[i : i + STEP_ROWS], node[i : i + STEP_ROWS]
        hit = np.flatnonzero(rows.octets[octet[k] + (r * (rows.w * 8))[:, None]] & mask[k])
        of = hit // m
        slot, k = hit - of * m, k[of]
        code = (k * m + slot) * BINS + (BINS - 1 - rows.bin(r[of], features[k, slot]).astype(np.int64))
        of += i
        found.append((code * classes + label[of]) * 16 + weight[of])
    x = np.sort(np.concatenate(found))
    w, x = x & 15, x >> 4
    code = x // classes
    return summed(code, x - code * classes, w, classes)


def summed(code: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of rising codes, and their weights by class."""
    last = np.flatnonzero(np.diff(code, append=-1))
    total = np.stack([np.cumsum(np.where(label == c, weight, 0)) for c in range(classes)], axis=1)[last]
    return code[last], np.diff(total, axis=0, prepend=0)


def chosen(code: np.ndarray, counts: np.ndarray, totals: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node: whether a split gains, its drawn feature's place and the least bin that goes right."""
    gains, slot, least = np.zeros(len(totals), bool), np.zeros(len(totals), np.int64), np.zeros(len(totals), np.int64)
    if not len(code):
        return gains, slot, least
    key = code // BINS
    up = np.cumsum(counts, axis=0)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    base = (up - counts)[first]
    right = (up - np.repeat(base, np.diff(first, append=len(key)), axis=0)).astype(np.float64)
    node = key // m
    left = totals[node] - right
    n_left, n_right = left.sum(axis=1), right.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(n_left > 0, (left * left).sum(axis=1) / n_left + (right * right).sum(axis=1) / n_right, -1.0)
    start = np.flatnonzero(np.diff(node, prepend=-1))
    best = np.maximum.reduceat(score, start)
    top = np.flatnonzero(score == np.repeat(best, np.diff(start, append=len(node))))
    at = top[np.flatnonzero(np.diff(node[top], prepend=-1))]  # one of each node
    own = totals[node[at]].astype(np.float64)
    at = at[score[at] > (own * own).sum(axis=1) / own.sum(axis=1) * (1 + 1e-12)]
    gains[node[at]], slot[node[at]], least[node[at]] = True, key[at] % m, BINS - 1 - code[at] % BINS
    return gains, slot, least


def grown(rows: Rows, label: np.ndarray, weight: np.ndarray, scored: np.ndarray, seed: int, tree: int, root: int,
          n_features: int, classes: int, max_depth: int) -> np.ndarray:
    """Class shares (in SHARE-ths) that the tree below ``root`` gives to the ``scored`` rows.  Trains on rows by weight."""
    shares = np.zeros((rows.n, classes), np.int64)
    row = np.flatnonzero((weight > 0) | scored)
    node, nodes, depth = np.zeros(len(row), np.int64), np.array([root], np.int64), root.bit_length() - 1
    while len(row):
        w = np.where(scored[row], 0, weight[row]).astype(np.int64)
        totals = np.bincount(node * classes + label[row], w, len(nodes) * classes).reshape(-1, classes)
        gains = np.zeros(len(nodes), bool)
        if depth < max_depth:
            mixed = (totals > 0).sum(axis=1) > 1
            at = np.flatnonzero(mixed)
            features = drawn_features(seed, tree, nodes[at], n_features)
            place = np.cumsum(mixed) - 1
            t = np.flatnonzero(mixed[node] & (w > 0))
            tally = tallied(rows, row[t], place[node[t]], label[row[t]], w[t], features, classes)
            ok, slot, least = chosen(*tally, totals[at], features.shape[1])
            at = at[ok]
            gains[at] = True
            feature, least = features[ok, slot[ok]], least[ok]
        done = np.flatnonzero(~gains[node] & scored[row])
        if len(done):
            own = totals[node[done]]
            shares[row[done]] = np.rint(own / np.maximum(own.sum(axis=1, keepdims=True), 1) * SHARE)
        if not gains.any():
            break
        on = gains[node]
        row, place = row[on], (np.cumsum(gains) - 1)[node[on]]
        right = rows.bin(row, feature[place]) >= least[place]
        node = 2 * place + right
        nodes = (2 * nodes[at][:, None] + np.arange(2)).ravel()
        depth += 1
    return shares


# ------------------------------------------------------------- over blocks
def entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of each value above zero of vectors as structs."""
    values = vectors.field("values")
    n = np.diff(values.offsets.to_numpy())
    row, value = np.repeat(np.arange(len(vectors)), n), values.flatten().to_numpy()
    feature = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)  # as in dense ones
    sparse = (vectors.field("type").to_numpy(zero_copy_only=False) == 0)[row]
    feature[sparse] = vectors.field("indices").flatten().to_numpy()
    if (value < 0).any():
        raise ValueError("features below zero")
    keep = value > 0
    return row[keep], feature[keep], value[keep]


class Block:
    """Some binned rows as they are kept and sent: id, label and test flag of each, and its values."""

    TYPE = "n long, ids binary, labels binary, scored binary, at binary, bins binary"

    def __init__(self, ids, labels, scored, at, bins):
        self.ids, self.labels, self.scored, self.at, self.bins = ids, labels, scored, at, bins

    @classmethod
    def read(cls, r: dict) -> Block:
        return cls(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.uint8).astype(np.int64),
                   np.frombuffer(r["scored"], bool), r["at"], r["bins"])

    def record(self) -> dict:
        return {"n": len(self.ids), "ids": self.ids.tobytes(), "labels": self.labels.astype(np.uint8).tobytes(),
                "scored": self.scored.tobytes(), "at": self.at, "bins": self.bins}

    def rows(self, n_features: int) -> Rows:
        return Rows(n_features, [(len(self.ids), self.at, self.bins)])

    def parts(self, n_features: int, chosen_rows: Iterator[np.ndarray]) -> Iterator[Block]:
        """The block of each lot of (rising) rows."""
        stride = _words(n_features) * 64
        at, bins = unpacked(self.at), np.frombuffer(self.bins, np.uint8)
        n = np.bincount(at // stride, minlength=len(self.ids))
        start = np.cumsum(n) - n
        for row in chosen_rows:
            k = n[row]
            i = np.arange(k.sum()) + np.repeat(start[row] - (np.cumsum(k) - k), k)
            moved = at[i] - np.repeat((row - np.arange(len(row))) * stride, k)
            yield Block(self.ids[row], self.labels[row], self.scored[row], packed(moved), bins[i].tobytes())


def _records(records: list[dict]) -> Iterator[pa.RecordBatch]:
    if records:
        yield pa.RecordBatch.from_pylist(records)


def _placed(nodes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose node is one of the rising ``of``, and its place there."""
    place = np.minimum(np.searchsorted(of, nodes), len(of) - 1)
    row = np.flatnonzero(of[place] == nodes)
    return row, place[row]


class Grower:
    """What the tasks know.  ``trees`` are (seed, number); nodes are numbered as in a heap, the root is 1."""

    def __init__(self, trees: list[tuple[int, int]], bounds: np.ndarray, classes: int, max_depth: int):
        self.trees, self.bounds, self.classes, self.max_depth = trees, bounds, classes, max_depth
        self.n_features = len(bounds)

    def row_bytes(self) -> int:
        """Bytes of a row in a task, without its bins."""
        return 10 * _words(self.n_features) + 32

    def blocks(self, batches: Iterator[pa.RecordBatch], nodes: bool) -> Iterator[pa.RecordBatch]:
        """Binned blocks of (id, label, is_test, f), with each tree's root for the rows it draws or scores."""
        for batch in batches:
            for b in (batch.slice(i, BLOCK_ROWS) for i in range(0, batch.num_rows, BLOCK_ROWS)):
                row, feature, value = entries(b.column("f"))
                ids, labels, scored = (b.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("id", np.int64), ("label", np.int64), ("is_test", bool)))
                block = Block(ids, labels, scored, packed(row * (_words(self.n_features) * 64) + feature), binned(feature, value, self.bounds).tobytes())
                roots = [((weights(*t, ids) > 0) | scored).astype(np.uint32).tobytes() for t in self.trees] if nodes else []
                yield from _records([block.record() | {"nodes": b"".join(roots)}])

    def opened(self, batches: Iterator[pa.RecordBatch], splits: list[dict[int, tuple]]) -> Iterator[tuple[dict, Block, Rows, np.ndarray]]:
        """Each block, with the rows of split nodes in their children (``splits``: by tree, of some levels)."""
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                block, nodes = Block.read(r), np.frombuffer(r["nodes"], np.uint32).reshape(len(self.trees), -1).copy()
                rows = block.rows(self.n_features)
                for level in splits:
                    for t, (of, feature, least) in level.items():
                        row, place = _placed(nodes[t], of)
                        nodes[t, row] = 2 * of[place] + (rows.bin(row, feature[place]) >= least[place])
                yield r, block, rows, nodes

    # -- nodes whose rows stay where they are ------------------------------
    TALLY = "tree long, node long, size long, totals binary, code binary, counts binary"

    def tally(self, batches: Iterator[pa.RecordBatch], splits: list, active: dict[int, tuple], depth: int) -> Iterator[pa.RecordBatch]:
        """Of each active node: its rows' bytes, weights by class, and those by drawn feature and bin."""
        found: dict[int, list] = {}
        drawn = {t: drawn_features(*self.trees[t], of, self.n_features) for t, (of,) in active.items()}
        for _, block, rows, nodes in self.opened(batches, splits):
            each = np.diff(rows.start, append=len(rows.bins)) + self.row_bytes()
            for t, (of,) in active.items():
                row, place = _placed(nodes[t], of)
                w = np.where(block.scored[row], 0, weights(*self.trees[t], block.ids[row])).astype(np.int64)
                size = np.bincount(place, each[row], len(of)).astype(np.int64)
                totals = np.bincount(place * self.classes + block.labels[row], w, len(of) * self.classes).astype(np.int64)
                on = np.flatnonzero(w) if depth < self.max_depth else np.zeros(0, np.int64)
                tally = tallied(rows, row[on], place[on], block.labels[row[on]], w[on], drawn[t], self.classes)
                found.setdefault(t, []).append((size, totals.reshape(len(of), -1), *tally))
        for t, parts in found.items():
            size, totals = sum(x[0] for x in parts), sum(x[1] for x in parts)
            code, counts = merged([x[2] for x in parts], [x[3] for x in parts])
            width = drawn[t].shape[1] * BINS
            cuts = np.searchsorted(code, np.arange(len(size) + 1) * width)
            yield from _records([{"tree": t, "node": int(node), "size": int(size[k]), "totals": totals[k].tobytes(),
                                  "code": (code[a:b] - k * width).tobytes(), "counts": counts[a:b].tobytes()}
                                 for k, (node, a, b) in enumerate(zip(active[t][0], cuts, cuts[1:], strict=False))])

    CHOICE = "tree long, node long, size long, totals binary, gains boolean, feature long, least long"

    def choice(self, table: pa.Table) -> pa.Table:
        """The split of one node."""
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        numbers = lambda c: [np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]
        totals = sum(numbers("totals"))
        code, counts = merged(numbers("code"), [x.reshape(-1, self.classes) for x in numbers("counts")])
        features = drawn_features(*self.trees[tree], np.array([node]), self.n_features)
        gains, slot, least = chosen(code, counts, totals[None], features.shape[1])
        return pa.table({"tree": pa.array([tree], pa.int64()), "node": pa.array([node], pa.int64()), "size": pa.array([sum(table.column("size").to_pylist())], pa.int64()),
                         "totals": pa.array([totals.tobytes()], pa.binary()), "gains": pa.array([bool(gains[0])]),
                         "feature": pa.array([int(features[0, slot[0]])], pa.int64()), "least": pa.array([int(least[0])], pa.int64())})

    def advance(self, batches: Iterator[pa.RecordBatch], splits: list) -> Iterator[pa.RecordBatch]:
        for r, _, _, nodes in self.opened(batches, splits):
            yield from _records([r | {"nodes": nodes.tobytes()}])

    def ended(self, batches: Iterator[pa.RecordBatch], splits: list, leaves: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        """Shares of scored rows in leaves whose rows stayed where they are."""
        for _, block, _, nodes in self.opened(batches, splits):
            shares = np.zeros((len(block.ids), self.classes), np.int64)
            for t, (of, share) in leaves.items():
                row, place = _placed(nodes[t], of)
                shares[row] += share[place]
            yield _shares(block.ids[block.scored], shares[block.scored])

    def parcels(self, batches: Iterator[pa.RecordBatch], splits: list, units: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        """The rows of each node that one task grows."""
        for _, block, _, nodes in self.opened(batches, splits):
            lots = []
            for t, (of, unit) in units.items():
                row, place = _placed(nodes[t], of)
                lots += [(int(unit[k]), row[place == k]) for k in np.unique(place)]
            for (unit, _), part in zip(lots, block.parts(self.n_features, (x[1] for x in lots)), strict=True):
                yield from _records([part.record() | {"unit": unit}])

    # -- nodes that one task grows -----------------------------------------
    def grow(self, batches: Iterator[pa.RecordBatch], units: list[tuple[list[int], int]]) -> Iterator[pa.RecordBatch]:
        """units: trees and root of each.  Shares of the scored rows, summed over the unit's trees."""
        held: dict[int, list[Block]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                held.setdefault(r["unit"], []).append(Block.read(r))
        batch = r = None
        while held:
            unit, blocks = held.popitem()
            trees, root = units[unit]
            ids, labels, scored = (np.concatenate([getattr(b, c) for b in blocks]) for c in ("ids", "labels", "scored"))
            packs = [(len(b.ids), b.at, b.bins) for b in blocks]
            del blocks
            rows = Rows(self.n_features, packs)
            shares = np.zeros((rows.n, self.classes), np.int64)
            for t in trees:
                shares += grown(rows, labels, weights(*self.trees[t], ids), scored, *self.trees[t], root, self.n_features, self.classes, self.max_depth)
            yield _shares(ids[scored], shares[scored])


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, count = np.concatenate(codes), np.concatenate(counts)
    by = np.argsort(code, kind="stable")
    code, count = code[by], count[by]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(count, first, axis=0) if len(first) else count


def _shares(ids: np.ndarray, shares: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64())} | {f"s_{c}": pa.array(shares[:, c], pa.int64()) for c in range(shares.shape[1])})


def _by_tree(found: list[tuple]) -> dict[int, tuple]:
    """(tree, node, values...) as rising nodes and their values by tree."""
    out: dict[int, list] = {}
    for t, *x in sorted(found, key=lambda x: x[:2]):
        out.setdefault(t, []).append(x)
    return {t: tuple(np.array(c) for c in zip(*x, strict=True)) for t, x in out.items()}


def class_shares(data: DataFrame, forests: list[tuple[int, int]], n_train: int, classes: int, max_depth: int) -> DataFrame:
    """(id, s_0, ...): over all trees, the sum of each test row's class shares, in SHARE-ths.

    ``data``: id (unique), label (0 to classes - 1), is_test, features (a vector, no value
    below zero), cheap to read often.  ``forests``: (seed, trees) of each.
    """
    vectors = data.select("id", "label", "is_test", F.unwrap_udt("features").alias("f"))
    n, values, n_features = vectors.agg(F.count(F.lit(1)), F.sum(F.size("f.values")), F.max(F.coalesce("f.size", F.size("f.values")))).first()
    train = vectors.where(~F.col("is_test")).select("f")
    sample = train if n_train <= QUANTILE_ROWS else train.sample(QUANTILE_ROWS / n_train, forests[0][0])
    parts = [entries(b.column("f")) for b in sample.toArrow().to_batches()] or [(np.zeros(0, np.int64),) * 3]
    bounds = thresholds(np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts]), n_features)

    trees = [(seed, k) for seed, m in forests for k in range(m)]
    grower = Grower(trees, bounds, classes, max_depth)
    shared = n * grower.row_bytes() + values <= LOCAL_BYTES
    blocks = tracked(vectors.mapInArrow(lambda b: grower.blocks(b, not shared), f"{Block.TYPE}, nodes binary").persist())
    shares = "id long, " + ", ".join(f"s_{c} long" for c in range(classes))
    if shared:  # whole trees, some to a task
        last = np.cumsum([m for _, m in forests])
        units = [(list(range(b - m, b)), 1) for b, (_, m) in zip(last.tolist(), forests, strict=True) if m]
        sent, ended = blocks.drop("nodes").withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(len(units) - 1)))), None
    else:
        blocks, splits, light, leaves = _split_above(blocks, grower)
        ended = blocks.mapInArrow(lambda b: grower.ended(b, splits, leaves), shares) if leaves else None
        units = [([t], node) for t, node in light]
        place = _by_tree([(t, node, k) for k, (t, node) in enumerate(light)])
        sent = blocks.mapInArrow(lambda b: grower.parcels(b, splits, place), f"{Block.TYPE}, unit long")
    out = sent.repartitionById(len(units), F.col("unit").cast("int")).mapInArrow(lambda b: grower.grow(b, units), shares) if units else ended
    out = out.unionByName(ended) if units and ended is not None else out
    return out.groupBy("id").agg(*[F.sum(f"s_{c}").alias(f"s_{c}") for c in range(classes)])


def _split_above(blocks: DataFrame, grower: Grower):
    """Splits nodes, a level at a time, until each is light or a leaf: (the blocks, the splits
    that their rows have still to pass, the light nodes, the leaves' shares by tree)."""
    active = [(t, 1) for t in range(len(grower.trees))]
    light, leaves, splits, depth = [], [], [], 0
    while active:
        if len(splits) == KEPT_LEVELS:
            blocks, splits = materialize(blocks.mapInArrow(lambda b, splits=splits: grower.advance(b, splits), f"{Block.TYPE}, nodes binary")), []
        found = (blocks.mapInArrow(lambda b, args=(splits, _by_tree(active), depth): grower.tally(b, *args), grower.TALLY)
                       .groupBy("tree", "node").applyInArrow(lambda x: grower.choice(x), grower.CHOICE).collect())  # a few numbers a heavy node
        light += [(r.tree, r.node) for r in found if r.size <= LOCAL_BYTES]
        heavy = [r for r in found if r.size > LOCAL_BYTES]
        totals = [(r, np.frombuffer(r.totals, np.int64)) for r in heavy if not r.gains]
        leaves += [(r.tree, r.node, np.rint(x / max(x.sum(), 1) * SHARE).astype(np.int64)) for r, x in totals]
        new = [(r.tree, r.node, r.feature, r.least) for r in heavy if r.gains]
        splits = [*splits, _by_tree(new)]
        active = [(t, 2 * node + side) for t, node, _, _ in new for side in (0, 1)]
        depth += 1
    return blocks, splits, sorted(light), _by_tree(leaves)
