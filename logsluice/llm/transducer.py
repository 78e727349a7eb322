"""Text measures by a table-driven byte transducer and a verified hash table of word spans.

The transducer reads the UTF-8 bytes of whole texts once. Its state says whether the
byte before belongs to a word; a transition gives the next state and flags that are
counted: a code point, a capital, a symbol, a word that begins or ends. Word spans go
into a hash table that holds places in the text, and spans count as equal only when
their bytes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from logsluice.llm.hashing import BASE, BYTE_CODES, PLACES, SPACE, mix, powers, text_slices

# Fixed values of the contract: [A-Z], and the symbols of [#$%&*|].
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#$%&*|"

OUTSIDE, INSIDE = 0, 1
BEGINS, ENDS, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16
PIECE_BYTES = 1 << 18
LONG_WORD = 4096
_MODULUS = 1 << 64


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, flags) by state * 256 + byte."""
    byte = np.arange(256)
    state = np.where(SPACE, OUTSIDE, INSIDE).astype(np.uint8)
    counted = np.where((byte & 0xC0) != 0x80, POINT, 0)
    counted |= np.where(np.isin(byte, [ord(c) for c in CAPITALS]), CAPITAL, 0)
    counted |= np.where(np.isin(byte, [ord(c) for c in SYMBOLS]), SYMBOL, 0)
    flags = np.zeros((2, 256), np.uint8)
    flags[OUTSIDE] = counted | np.where(state == INSIDE, BEGINS, 0)
    flags[INSIDE] = counted | np.where(state == OUTSIDE, ENDS, 0)
    return np.stack((state, state)), flags


NEXT, FLAGS = transitions()
# A byte alone decides the next state, from either state; so the states of a whole
# piece are one table look-up, and its flags another.
assert (NEXT[OUTSIDE] == NEXT[INSIDE]).all()
STEP, FLAT = NEXT[OUTSIDE], FLAGS.reshape(-1)
FORWARD = powers(PIECE_BYTES + 1)
_INVERSE = np.uint64(pow(int(BASE), -1, _MODULUS))
BACKWARD = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(PIECE_BYTES, _INVERSE, np.uint64))))


def same_bytes(data: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans at ``left`` and ``right``, pairwise of equal size, hold equal bytes."""
    same = np.ones(len(sizes), bool)
    for i in np.flatnonzero(sizes > LONG_WORD):
        a, b, n = int(left[i]), int(right[i]), int(sizes[i])
        same[i] = np.array_equal(data[a : a + n], data[b : b + n])
    short = np.flatnonzero(sizes <= LONG_WORD)
    if len(short):
        size = sizes[short]
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        inside = np.arange(int(size.sum())) - np.repeat(first, size)
        differ = data[np.repeat(left[short], size) + inside] != data[np.repeat(right[short], size) + inside]
        same[short] = np.add.reduceat(differ, first, dtype=np.int64) == 0
    return same


class SpanTable:
    """An open-addressing table of (row, word) spans over one byte array.

    Slots hold numbers of entries; an entry is a row, a start, a size and a hash.
    A span is known if an entry on its probe path has its row, size and bytes; the hash
    only chooses the path and spares comparisons.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        self.slots = np.full(1 << 10, -1, np.int64)
        self.used = 0
        self.entries = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)]

    def insert(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Adds spans that are not there yet; says which were added."""
        n, base = len(rows), self.used
        self._reserve(base + n)
        row, start, size, code = columns = self._with((rows, starts, sizes, hashes))
        mask = len(self.slots) - 1
        at = (code[base : base + n] & np.uint64(mask)).astype(np.int64)
        added = np.zeros(n, bool)
        pending = np.arange(n)
        while len(pending):
            here = at[pending]
            free = self.slots[here] < 0
            # Of several spans for one free slot the last one written has it.
            self.slots[here[free]] = base + pending[free]
            holder, own = self.slots[here], base + pending
            mine = holder == own
            added[pending[mine]] = True
            alike = ~mine & (code[holder] == code[own]) & (size[holder] == size[own]) & (row[holder] == row[own])
            asked = np.flatnonzero(alike)
            if len(asked):
                alike[asked] = same_bytes(self.data, start[holder[asked]], start[own[asked]], size[own[asked]])
            pending = pending[~mine & ~alike]
            at[pending] = (at[pending] + 1) & mask
        number = base + np.cumsum(added) - 1
        self.slots[at[added]] = number[added]
        keep = base + np.flatnonzero(added)
        for column in columns:
            column[base : base + len(keep)] = column[keep]
        self.entries, self.used = list(columns), base + len(keep)
        return added

    def _with(self, new: tuple) -> tuple:
        """The entries' columns with the new ones behind those in use, grown by doubling."""
        need, out = self.used + len(new[0]), []
        for held, values in zip(self.entries, new, strict=True):
            if len(held) < need:
                held = np.concatenate((held[: self.used], np.zeros(max(need, 2 * self.used) - self.used, held.dtype)))
            held[self.used : need] = values
            out.append(held)
        return tuple(out)

    def _reserve(self, entries: int) -> None:
        """Keeps the table at most half full."""
        size = len(self.slots)
        if 2 * entries <= size:
            return
        while size < 2 * entries:
            size *= 2
        self.slots = np.full(size, -1, np.int64)
        at = (self.entries[3][: self.used] & np.uint64(size - 1)).astype(np.int64)
        pending = np.arange(self.used)
        while len(pending):
            here = at[pending]
            free = self.slots[here] < 0
            self.slots[here[free]] = pending[free]
            pending = pending[self.slots[here] != pending]
            at[pending] = (at[pending] + 1) & (size - 1)


def measure(data: np.ndarray, bounds: np.ndarray, piece: int = PIECE_BYTES) -> np.ndarray:
    """Per text: words, distinct words, capitals, code points, symbols. Text i is data[bounds[i]:bounds[i + 1]].

    Bytes are read in pieces of fixed size; the state, and a word that runs over the end
    of a piece, with its hash so far, are carried into the next.
    """
    texts = len(bounds) - 1
    words, distinct, capitals, points, symbols = counts = np.zeros((5, texts), np.int64)
    table = SpanTable(data)
    carried, open_start, open_hash = OUTSIDE, -1, 0
    filled = np.flatnonzero(np.diff(bounds) > 0)
    heads, tails = bounds[:-1][filled], bounds[1:][filled]
    for lo in range(0, len(data), piece):
        hi = min(lo + piece, len(data))
        byte = data[lo:hi]
        state = STEP[byte]
        before = np.empty(hi - lo, np.uint16)
        before[0], before[1:] = carried, state[:-1]
        before[heads[np.searchsorted(heads, lo) : np.searchsorted(heads, hi)] - lo] = OUTSIDE
        flags = FLAT[before * np.uint16(256) + byte]
        carried = int(state[-1])

        first = np.searchsorted(heads, lo, "right") - 1
        parts = np.maximum(heads[first : np.searchsorted(heads, hi)], lo)
        held = filled[first : first + len(parts)]
        for flag, total in ((POINT, points), (CAPITAL, capitals), (SYMBOL, symbols)):
            total[held] += np.add.reduceat((flags & flag) != 0, parts - lo, dtype=np.int64)

        closed = tails[np.searchsorted(tails, lo, "right") : np.searchsorted(tails, hi, "right")]
        closed = closed[state[closed - lo - 1] == INSIDE]
        ends = np.sort(np.concatenate((np.flatnonzero(flags & ENDS) + lo, closed)))
        starts = np.flatnonzero(flags & BEGINS) + lo
        if open_start >= 0:
            starts = np.concatenate(([open_start], starts))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[byte] * FORWARD[: hi - lo])))
        from_ = np.maximum(starts, lo) - lo
        to = np.full(len(starts), hi - lo)
        to[: len(ends)] = ends - lo
        hashes = (sums[to] - sums[from_]) * BACKWARD[from_]
        if open_start >= 0:
            shift = pow(int(BASE), lo - open_start, _MODULUS)
            hashes[0] = np.uint64((open_hash + int(hashes[0]) * shift) % _MODULUS)
        open_start, open_hash = -1, 0
        if len(starts) > len(ends):
            open_start, open_hash = int(starts[-1]), int(hashes[-1])
            starts, hashes = starts[:-1], hashes[:-1]
        if len(starts):
            rows = filled[np.searchsorted(heads, starts, "right") - 1]
            sizes = ends - starts
            # The row is part of the hash: a word of many rows would else make one long probe path.
            told = hashes + sizes.astype(np.uint64) * PLACES[7] + rows.astype(np.uint64) * PLACES[6]
            added = table.insert(rows, starts, sizes, mix(told))
            words += np.bincount(rows, minlength=texts)
            distinct += np.bincount(rows[added], minlength=texts)
    return counts


MEASURES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the column ``text``, the last, by the measures of each row's whole text."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        found = [np.zeros((5, 0), np.int64)]
        for part in text_slices(texts):
            found.append(measure(part.data, part.bounds))
        held = batch.columns[:-1] + [pa.array(row) for row in np.concatenate(found, axis=1)]
        yield pa.RecordBatch.from_arrays(held, names=[*batch.schema.names[:-1], *MEASURES])
