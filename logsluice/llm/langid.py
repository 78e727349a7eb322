"""Language ID: script ranges narrow the candidates, Viterbi labels the words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import hash_unit, held_out, pick
from logsluice.llm.hashing import BYTE_CODES, PLACES, SLICE_BYTES, Slice, Words, mix, text_slices, words_of

# First code points of the Unicode blocks told apart, and their script.
SCRIPTS = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "none"),
    (0x2C00, "other"),
    (0x3000, "none"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0x20000, "han"),
    (0x32400, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS if name != "none"})
STARTS = np.array([start for start, _ in SCRIPTS])
CODES = np.array([NAMES.index(name) if name != "none" else -1 for _, name in SCRIPTS])

UNDECIDED = "und"
BITS = 16
SIZES = (2, 3, 4)
# The model is fitted on at most about this many bytes of text for each language.
SAMPLE_BYTES = 4_000_000
SWITCH = 12.0
RARE_SCRIPT = 0.02
BLOCK = 64
OUTSIDE = -50.0

# Words are letters with their marks; every other character separates them. Marks without a
# letter before them and separators beyond ASCII are blanked first, so that here all bytes
# beyond ASCII belong to words and a word's first character is a letter.
SEPARATORS = r"[^\p{L}\p{M}\x00-\x7F]+"
LOOSE_MARKS = r"(^|[^\p{L}\p{M}])\p{M}+"
INNER = np.zeros(256, bool)
INNER[97:123] = True
INNER[128:] = True


def _lower(texts: pa.Array) -> pa.Array:
    """Lower-case texts in which only letters and their marks are left beyond ASCII."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if pc.all(pc.string_is_ascii(lower)).as_py() is not False:
        return lower
    spaced = pc.replace_substring_regex(lower, SEPARATORS, " ")
    return pc.replace_substring_regex(spaced, LOOSE_MARKS, "\\1 ")


def _scripts(words: Words) -> np.ndarray:
    """The script of each word by its first letter; -1 where letters of all scripts may stand."""
    lead = words.data[words.starts].astype(np.int64)
    last = len(words.data) - 1
    follow = [words.data[np.minimum(words.starts + i, last)].astype(np.int64) & 63 for i in (1, 2, 3)]
    points = np.select(
        [lead < 0x80, lead < 0xE0, lead < 0xF0],
        [
            lead,
            ((lead & 31) << 6) | follow[0],
            ((lead & 15) << 12) | (follow[0] << 6) | follow[1],
        ],
        ((lead & 7) << 18) | (follow[0] << 12) | (follow[1] << 6) | follow[2],
    )
    return CODES[np.searchsorted(STARTS, points, "right") - 1]


def _grams(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of the chosen words (with both word edges), and whose they are."""
    starts, sizes = words.starts[chosen], (words.ends - words.starts)[chosen]
    wide = sizes + 2
    first = np.concatenate(([0], np.cumsum(wide)[:-1])) if len(wide) else np.zeros(0, np.int64)
    total = int(wide.sum())
    owner = np.repeat(np.arange(len(chosen)), wide)
    inside = np.arange(total) - first[owner]
    source = np.clip(starts[owner] + inside - 1, 0, max(len(words.data) - 1, 0))
    codes = BYTE_CODES[words.data[source]]
    codes[(inside == 0) | (inside == wide[owner] - 1)] = BYTE_CODES[32]
    found, whose = [], []
    for n in SIZES:
        if total < n:
            continue
        h = np.full(total - n + 1, np.uint64(n))
        for i in range(n):
            h += codes[i : total - n + 1 + i] * PLACES[i]
        good = owner[: total - n + 1] == owner[n - 1 :]
        found.append((mix(h[good]) >> np.uint64(64 - BITS)).astype(np.int64))
        whose.append(owner[: total - n + 1][good])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(whose)


@dataclass
class Model:
    """Per language: log shares of the n-gram buckets, and which scripts it is written in."""

    langs: list[str]
    table: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        """Mean log share of each word's n-grams times its length in letters, by language."""
        if len(words.hashes) == 0:
            return np.zeros((0, len(self.langs)), np.float32)
        _, chosen, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        buckets, whose = _grams(words, chosen)
        score = np.stack(
            [np.bincount(whose, self.table[buckets, j], len(chosen)) for j in range(len(self.langs))], axis=1
        )
        score /= len(SIZES)
        scripts = _scripts(words)[chosen]
        known = scripts >= 0
        barred = ~self.allowed[scripts] & known[:, None]
        # A script that no learned language uses leaves all of them as candidates.
        barred[barred.all(axis=1)] = False
        score = score - score.max(axis=1, keepdims=True)
        score[barred] = OUTSIDE
        return score.astype(np.float32)[back]


def viterbi(scores: np.ndarray, rows: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of all words: sum of word scores less ``switch`` for each change inside a row.

    Rows are cut into blocks of 64 words. All blocks advance together, for each label
    they may begin with; then the blocks of a row are joined in order and the best
    path is followed back. The result is that of one pass over each row.
    """
    n, k = scores.shape
    labels = np.zeros(n, np.int64)
    counts = np.diff(rows)
    blocks = -(-counts // BLOCK)
    total = int(blocks.sum())
    if not total:
        return labels
    row = np.repeat(np.arange(len(counts)), blocks)
    first_block = np.concatenate(([0], np.cumsum(blocks)))
    begin = rows[:-1][row] + (np.arange(total) - first_block[:-1][row]) * BLOCK
    size = np.minimum(BLOCK, rows[1:][row] - begin)
    order = np.argsort(-size, kind="stable")
    best = np.full((total, k, k), -np.inf, np.float32)
    best[:, np.arange(k), np.arange(k)] = scores[begin]
    full = np.zeros((int(size.max()), total, k, k), np.int8 if k < 128 else np.int16)
    for step in range(1, int(size.max())):
        alive = order[: np.searchsorted(-size[order], -step, "left")]
        now = best[alive]
        top, at = now.max(axis=2), now.argmax(axis=2)
        change = (top - switch)[:, :, None] > now
        best[alive] = np.where(change, (top - switch)[:, :, None], now) + scores[begin[alive] + step][:, None, :]
        # Where the path changes, the label before is that start's best one.
        full[step, alive] = np.where(change, at[:, :, None], np.arange(k)[None, None, :])
    # Join the blocks of each row: value of ending block b with a label.
    ends = np.full((total, k), -np.inf, np.float32)
    entry = np.zeros((total, k), np.int64)
    before = np.zeros((total, k), np.int64)
    for turn in range(int(blocks.max())):
        here = first_block[:-1][blocks > turn] + turn
        if turn == 0:
            coming = np.zeros((len(here), k), np.float32)
        else:
            past = ends[here - 1]
            top, at = past.max(axis=1), past.argmax(axis=1)
            change = (top - switch)[:, None] > past
            coming = np.where(change, (top - switch)[:, None], past)
            before[here] = np.where(change, at[:, None], np.arange(k)[None, :])
        value = coming[:, :, None] + best[here]
        ends[here], entry[here] = value.max(axis=1), value.argmax(axis=1)
        ends[here] -= ends[here].max(axis=1, keepdims=True)
    # Back through the blocks, then inside all blocks at once.
    final, chosen_start = np.zeros(total, np.int64), np.zeros(total, np.int64)
    for turn in range(int(blocks.max()) - 1, -1, -1):
        here = first_block[:-1][blocks > turn] + turn
        last = (first_block[1:][blocks > turn] - 1) == here
        nxt = np.minimum(here + 1, total - 1)
        final[here] = np.where(last, ends[here].argmax(axis=1), before[nxt, chosen_start[nxt]])
        chosen_start[here] = entry[here, final[here]]
    current, every = final.copy(), np.arange(total)
    for step in range(int(size.max()) - 1, -1, -1):
        here = every[size > step]
        labels[begin[here] + step] = current[here]
        if step:
            current[here] = full[step, here, chosen_start[here], current[here]]
    return labels


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Learns from rows with ``text`` and ``lang``; None when there is none.

    The bounded sample: whole documents in hash order of their text, at a rate that
    gives about ``sample_bytes`` for each language (all of a smaller one). What
    returns to the driver is a table of 2 ** 16 counts for each language.
    """
    rows = pick(docs, text="string", lang="string").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).orderBy("lang").collect()
    langs = [r[0] for r in sizes]
    if not langs:
        return None
    rate = F.lit(0.0)
    for r in sizes:
        rate = F.when(F.col("lang") == r[0], F.lit(sample_bytes / max(r[1], 1))).otherwise(rate)
    sample = rows.where(hash_unit("text") < rate)
    number = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, np.ndarray] = {}
        scripts: dict[int, np.ndarray] = {}
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for part in text_slices(_lower(batch.column(0))):
                words = words_of(part, INNER)
                of = lang[part.lo : part.hi][words.row_of()]
                buckets, whose = _grams(words, np.arange(len(words.hashes)))
                kinds = _scripts(words)
                for j in np.unique(of):
                    grams[j] = grams.get(j, 0) + np.bincount(buckets[of[whose] == j], minlength=1 << BITS)
                    seen = kinds[(of == j) & (kinds >= 0)]
                    scripts[j] = scripts.get(j, 0) + np.bincount(seen, minlength=len(NAMES))
        keys, values, which = [], [], []
        for j in grams:
            for base, found in ((0, grams[j]), (1 << BITS, scripts[j])):
                at = np.flatnonzero(found)
                keys.append(at + base)
                values.append(found[at])
                which.append(np.full(len(at), j))
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in (which, keys, values)], ["l", "k", "n"]
            )

    counted = sample.mapInArrow(count, "l long, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most langs x (2 ** BITS + scripts) rows
    counts = np.zeros((len(langs), (1 << BITS) + len(NAMES)))
    counts[found["l"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy()
    grams, scripts = counts[:, : 1 << BITS], counts[:, 1 << BITS :]
    logs = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS)))
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(langs, np.ascontiguousarray(logs.T.astype(np.float32)), np.ascontiguousarray((share > RARE_SCRIPT).T))


def label(part: Slice, model: Model, switch: float = SWITCH) -> tuple[Words, np.ndarray]:
    """The words of a slice and their labels."""
    words = words_of(part, INNER)
    return words, viterbi(model.word_scores(words), words.rows, switch)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Labels every word of ``docs`` (doc_id, text) and sums up by document.

    Returns doc_id, lang_pred, score and spans: runs of words with one label, as first
    word, number of words and language. ``lang_pred`` is the language with the most
    bytes of words, ties going to the first in order; ``score`` is its share of them.
    Words are runs of letters with their marks, whatever punctuation stands around them; a
    word whose script no learned language is written in keeps all languages as candidates.
    A text that is null or has no letter is ``und`` with score 0 and no spans, and so
    is every text without a model; every other text gets a learned language. Only the
    text decides.
    """
    base = pick(docs, doc_id="long", text="string")
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    schema = "doc_id long, lang_pred string, score double, spans array<struct<first:int,words:int,lang:string>>"
    if model is None:
        empty = F.array().cast("array<struct<first:int,words:int,lang:string>>")
        return base.select(
            "doc_id", F.lit(UNDECIDED).alias("lang_pred"), F.lit(0.0).alias("score"), empty.alias("spans")
        )
    shared = base.sparkSession.sparkContext.broadcast(model)  # langs x 2 ** BITS floats

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pred, score, spans in _decide(batch.column("text"), batch.column("lettered"), shared.value):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.lo, part.hi - part.lo), pred, score, spans],
                    ["doc_id", "lang_pred", "score", "spans"],
                )

    return base.withColumn("lettered", lettered).mapInArrow(decide, schema)


def _decide(texts: pa.Array, lettered: pa.Array, model: Model, switch: float = SWITCH):
    """Slice by slice: the slice, and predictions, scores and spans of its rows."""
    names = pa.array(model.langs, pa.string())
    limit = min(SLICE_BYTES, max(1 << 16, 16 * SLICE_BYTES // len(names) ** 2))
    kinds = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])
    for part in text_slices(_lower(texts), limit):
        rows = part.hi - part.lo
        words, labels = label(part, model, switch)
        of = words.row_of()
        weight = words.ends - words.starts
        mass = np.bincount(of * len(names) + labels, weight, rows * len(names)).reshape(rows, -1)
        sums = mass.sum(axis=1)
        good = lettered.slice(part.lo, rows).to_numpy(zero_copy_only=False) & (sums > 0)
        pred = np.where(good, mass.argmax(axis=1), len(names))
        score = np.where(good, mass.max(axis=1) / np.maximum(sums, 1), 0.0)
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (labels[1:] != labels[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(of)))
        size, at = size[good[of[at]]], at[good[of[at]]]
        spans = pa.StructArray.from_arrays(
            [
                pa.array((at - words.rows[:-1][of[at]]).astype(np.int32)),
                pa.array(size.astype(np.int32)),
                names.take(pa.array(labels[at])),
            ],
            fields=list(kinds),
        )
        bounds = np.searchsorted(of[at], np.arange(rows + 1)).astype(np.int32)
        yield (
            part,
            pa.concat_arrays([names, pa.array([UNDECIDED])]).take(pa.array(pred)),
            pa.array(score),
            pa.ListArray.from_arrays(pa.array(bounds), spans),
        )


def keep_identified(docs: DataFrame, least: float, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``docs`` without the rows whose language is undecided or scores under ``least``.

    All columns stay as they are; a null ``lang`` becomes the language found. Learns
    from the same rows as ``identify_documents``. Rows are only mapped, not moved.
    Without a model (no text with a language), no language can be told and every row stays.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"), 4, 2)), sample_bytes)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)  # langs x 2 ** BITS floats
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pred, score, _ in _decide(batch.column("text"), batch.column("lettered"), shared.value):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(part.lo, part.hi - part.lo), pred, score], ["row", "lang_pred", "score"]
                )

    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    found = rows.mapInArrow(decide, schema).where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= least))
    return found.select(
        *(
            F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias("lang")
            if name == "lang"
            else F.col(f"row.`{name}`").alias(name)
            for name in docs.columns
        )
    )


def identify_documents(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Language of every document, learned from those with crc32(doc_id) mod 4 other than 2.

    Needs doc_id, text and lang; other columns are ignored. Returns doc_id, held_out,
    lang_pred, score and spans. ``lang`` is used for fitting only. A null ``lang``
    teaches nothing; a null doc_id is not held out; repeated rows are labelled alike.
    A very long text is one slice of a task (about 100 bytes of memory for each byte).
    An empty table gives no rows.
    """
    base = pick(docs, doc_id="long", text="string", lang="string")
    model = fit(base.where(~held_out(F.col("doc_id"), 4, 2)), sample_bytes)
    found = identify(base, model)
    return found.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "spans"
    )
