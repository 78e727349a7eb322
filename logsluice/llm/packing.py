"""Packing tokenised documents into fixed windows with bounded-space best fit."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import pick, stored

WINDOW = 1024
OPEN_WINDOWS = 16
MIN_PIECE = 8
# Partitions whose leftovers are merged in one task: at most MERGED * OPEN_WINDOWS windows.
MERGED = 256
END_ID = 0
# Fixed value: the one special token of the vocabulary, and its id.
SPECIAL = {"<|endoftext|>": 50256}


def tokenizer(vocabulary: str | None = None, ranks: str | None = None) -> Callable[[str], np.ndarray]:
    """Ids of a text as the vocabulary's own library gives them, without added tokens.

    The same vocabulary as ranks is several times faster and gives equal ids (a test
    compares them); a text with the special token in it goes to the library itself.
    Paths default to the installed files and are looked up where this runs.
    """
    import base64

    import public_tokenizers as files
    import tiktoken

    with open(ranks or files.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=merges, special_tokens={})
    slow = []

    def ids(text: str) -> np.ndarray:
        if any(mark in text for mark in SPECIAL):
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(vocabulary or files.path("byte_bpe_50k.json")))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(fast.encode_ordinary(text), "<u4")

    return ids


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


@dataclass
class Window:
    free: int
    pieces: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.free -= len(piece.ids)


class Packer:
    """A fixed number of open windows; ``done`` collects the emitted ones.

    A piece goes into the open window it leaves the least room in. When none has
    room for it and no further window may be opened, the fullest is emitted; the
    piece is cut to fill that one's rest first, unless the rest or what remains is
    under ``min_piece`` ids.
    """

    def __init__(self, size: int = WINDOW, windows: int = OPEN_WINDOWS, min_piece: int = MIN_PIECE) -> None:
        self.size, self.windows, self.min_piece = size, windows, min_piece
        self.open: list[Window] = []
        self.done: list[Window] = []

    def add(self, piece: Piece) -> None:
        while len(piece.ids) >= self.size:
            head, piece = _cut(piece, self.size)
            self.done.append(Window(0, [head]))
        while len(piece.ids):
            length = len(piece.ids)
            fitting = [w for w in self.open if w.free >= length]
            if fitting:
                best = min(fitting, key=lambda w: w.free)
            elif len(self.open) < self.windows:
                best = Window(self.size)
                self.open.append(best)
            else:
                best = min(self.open, key=lambda w: w.free)
                if best.free >= self.min_piece and length - best.free >= self.min_piece:
                    head, piece = _cut(piece, best.free)
                    best.add(head)
                self._emit(best)
                continue
            best.add(piece)
            if not best.free:
                self._emit(best)
            return

    def _emit(self, window: Window) -> None:
        self.open = [w for w in self.open if w is not window]
        self.done.append(window)

    def close(self) -> list[Window]:
        """The windows still open, fullest first."""
        left, self.open = sorted(self.open, key=lambda w: w.free), []
        return left


def _cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    head = Piece(piece.doc_id, piece.start, piece.ids[:at], piece.doc_tokens)
    return head, Piece(piece.doc_id, piece.start + at, piece.ids[at:], piece.doc_tokens)


PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("part", pa.int32()),
        ("rest", pa.binary()),
    ]
)
PIECES_SQL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, part int, rest binary"
)


def _rows(windows: list[Window], first: int, part: int, rest: bool) -> pa.RecordBatch:
    rows = []
    for number, window in enumerate(windows, first):
        offset = 0
        for p in window.pieces:
            raw = p.ids.tobytes()
            length = len(p.ids)
            rows.append(
                (
                    p.doc_id,
                    p.start,
                    length,
                    zlib.crc32(raw),
                    p.doc_tokens,
                    number,
                    offset,
                    part,
                    raw if rest else None,
                )
            )
            offset += length
    columns = zip(*rows, strict=True) if rows else [[]] * len(PIECES)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES
    )


def pack_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    ranks: str | None = None,
    size: int = WINDOW,
    windows: int = OPEN_WINDOWS,
    min_piece: int = MIN_PIECE,
) -> DataFrame:
    """Packs all documents into sequences of at most ``size`` ids.

    Needs ``doc_id`` and ``text``; other columns are ignored. A document is the ids
    of its text and then id 0. Returns one row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id and offset.

    Each partition of the input is packed as it is read, with ``windows`` open
    windows, so a task holds one document and these. What is still open at its
    end is written with its ids to the shared folder; the leftovers of
    ``MERGED`` partitions are then packed together, longest pieces first, and the
    last open windows of a merge are filled up one after another. Sequence
    numbers come from the partition, so a task that is run again gives the same
    rows. Padding is under ``min_piece`` ids a sequence, and in one sequence of a merge
    more.

    A null or empty text is the id 0 alone; a null doc_id is carried as it is;
    repeated rows are packed one by one. An empty table gives no rows. A long
    document makes full sequences of its own and one rest.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids_of, packer, number = tokenizer(vocabulary, ranks), Packer(size, windows, min_piece), part << 40
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(ids_of(text.as_py() or ""), np.array([END_ID], "<u4"))
                packer.add(Piece(doc_id, 0, ids, len(ids)))
                if len(packer.done) >= 500:
                    yield _rows(packer.done, number, part, False)
                    number, packer.done = number + len(packer.done), []
        yield _rows(packer.done, number, part, False)
        yield _rows(packer.close(), number + len(packer.done), part, True)

    def merge(key: tuple, leftovers: pa.Table) -> pa.Table:
        pieces = [
            Piece(row["doc_id"], row["start"], np.frombuffer(row["rest"], "<u4"), row["doc_tokens"])
            for row in leftovers.to_pylist()
        ]
        pieces.sort(key=lambda p: (-len(p.ids), p.doc_id is None, p.doc_id or 0, p.start, p.ids.tobytes()))
        packer, last = Packer(size, windows, min_piece), Packer(size, 1, 1)
        for piece in pieces:
            packer.add(piece)
        for window in packer.close():
            for piece in window.pieces:
                last.add(piece)
        group = key[0].as_py()
        rows = _rows(packer.done + last.done + last.close(), (1 << 62) + (group << 40), group, False)
        return pa.Table.from_batches([rows])

    packed = stored(pick(docs, doc_id="long", text="string").mapInArrow(pack, PIECES_SQL), "packed")
    columns = PIECES.names[:7]
    merged = (
        packed.where("rest IS NOT NULL")
        .groupBy((F.col("part") / MERGED).cast("int").alias("__group"))
        .applyInArrow(merge, PIECES_SQL)
    )
    return packed.where("rest IS NULL").select(*columns).unionByName(merged.select(*columns))

