"""Words of Arrow text columns as 64-bit hashes, without a Python loop per word.

A word's hash is a polynomial in its bytes modulo 2**64: prefix sums over a
slice of texts give every word's value in a few numpy passes.  They need some
60 bytes of memory for each byte of the slice, or of one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about so many bytes (a longer text alone).
SLICE_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of words that white space separates.
BY_SPACE = ~SPACES
#: Bytes of words made of letters, digits and non-ASCII characters.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Bytes of words made of letters and non-ASCII characters.
LETTERS = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)  # A-Z count as a-z
    return mix(lower + np.uint64(0x51ED270B))


@lru_cache(maxsize=1)
def _exact_values() -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(0x7F4A7C15))


_STANDARD = SLICE_BYTES + 4096


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _standard_powers() -> tuple[np.ndarray, np.ndarray]:
    return _both_powers(_STANDARD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a text longer than a slice are not held on to."""
    return _standard_powers() if n <= _STANDARD else _both_powers(n)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of runs of texts; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each text's first word (one more at the end)."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    is_word = inside[data]
    edge = np.empty(len(data), bool)
    edge[0], edge[1:] = True, ~is_word[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(is_word & edge)
    edge[-1], edge[:-1] = True, ~is_word[1:]
    edge[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(is_word & edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return sums


def inverse_powers(n: int) -> np.ndarray:
    """What scales the value of a span by where it starts, for ``n`` prefix sums (or some more)."""
    return _powers(n)[1]


def span_values(begun: np.ndarray, done: np.ndarray, scale: np.ndarray, length) -> np.ndarray:
    """Values of spans by the prefix sums where they start and end, before they are spread by ``mix``."""
    out = done - begun
    out *= scale
    out += np.asarray(length).astype(np.uint64)
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of the bytes whose prefix sums are given."""
    return mix(span_values(sums[starts], sums[ends], inverse_powers(len(sums))[starts], ends - starts))


def exact_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums that tell upper from lower case."""
    return prefix_sums(data, _exact_values())


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = BY_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z as a-z, and each text's first word (one more at the end)."""
    starts, ends, first = word_bounds(data, offsets, inside)
    if not len(starts):
        return np.empty(0, np.uint64), first
    return span_hashes(prefix_sums(data, _byte_values()), starts, ends), first


def hash_of(words: str) -> list[int]:
    """Hashes of the words of a fixed phrase, as ``word_hashes`` gives them."""
    raw = np.frombuffer(words.encode(), np.uint8)
    return [int(h) for h in word_hashes(raw, np.array([0, len(raw)]), BY_SPACE)[0]]


_STEP = np.uint64(0xD6E8FEB86659FD93)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring words (texts are not told apart)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= _STEP
        out += hashes[k: k + count]
    return mix(out)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingles of one text: its runs of ``n`` words, or with
    fewer words the whole sequence as one; no words, no shingles."""
    if not len(hashes):
        return hashes
    return np.unique(grams(hashes, min(n, len(hashes))))
