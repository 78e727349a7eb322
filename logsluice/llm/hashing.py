"""Words, shingles and their hashes of whole Arrow batches, in numpy.

A text is cut and hashed without a Python object per word: all texts of a slice
are one byte array, and every step is one numpy call over it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_random = np.random.Generator(np.random.PCG64(20240131))
BYTE_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _random.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = np.cumprod(np.full(n - 1, BASE, np.uint64))
    return out


@dataclass
class Slice:
    """Rows lo..hi of a batch: their texts' bytes, and each text's bounds in them."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a text column into runs of whole rows of about ``limit`` bytes; null reads as empty.

    A row longer than ``limit`` makes a slice of its own.
    """
    if len(texts) == 0:
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield Slice(lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi


@dataclass
class Words:
    """All words of a slice, in order: bounds in ``data``, hash, and each row's range of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())


def hash_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    inside = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    terms = BYTE_CODES[data[inside + np.repeat(starts, sizes)]] * powers(int(sizes.max()))[inside]
    return mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64) * PLACES[7])


def words_of(part: Slice, inner: np.ndarray | None = None) -> Words:
    """Words of a slice, A-Z lower-cased.

    ``inner`` says for each byte value whether it is part of a word; as a rule all but
    the white space [\\x20\\x09-\\x0D]. No word runs from one text into the next.
    """
    data = LOWER[part.data]
    inside = ~SPACE[data] if inner is None else inner[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[part.bounds] = True
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    finishes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    rows = np.searchsorted(starts, part.bounds, "left")
    return Words(data, starts, ends, hash_pieces(data, starts, ends), rows)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles and the row of each, rows ascending, repeats included.

    A row with fewer than ``size`` words has its whole sequence as its one shingle; a
    row without words has none.
    """
    counts, h = words.counts(), words.hashes
    n = len(h)
    whole = np.zeros(n, np.uint64)
    for place in range(size):
        whole[: n - place] += h[place:] * PLACES[place]
    last = np.repeat(words.rows[1:], counts)
    rows = words.row_of()
    good = np.arange(n) + size <= last
    short = np.flatnonzero((counts > 0) & (counts < size))
    made, of = whole[good], rows[good]
    if len(short):
        sums = np.array(
            [np.sum(h[words.rows[r] : words.rows[r + 1]] * PLACES[: counts[r]], dtype=np.uint64) for r in short],
            np.uint64,
        )
        sums += counts[short].astype(np.uint64) * PLACES[6]
        made, of = np.concatenate((made, sums)), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        made, of = made[order], of[order]
    return mix(made), of
