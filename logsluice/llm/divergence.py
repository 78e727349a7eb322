"""Source divergence audit: how the sources of a language differ in their frequent terms.

Frequent terms are found by iceberg prefix refinement: byte prefixes of terms are
counted by distinct documents, prefixes in too few documents are discarded with all
terms below them, the others are extended, until only complete terms remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsluice.llm.common import forget, pick, stored
from logsluice.llm.hashing import LOWER, text_slices

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000

# Length of the first prefixes in bytes; each level doubles it.
FIRST_PREFIX = 8
BLOCK_BYTES = 16 << 20
# 64-bit words of a filter of prefixes: at most this many rows are broadcast.
WORDS = 1 << 18
PIECE_BYTES = 4 << 20
# Rows of one task of the comparison, and sources on each side of it.
ROWS_A_SALT = 1 << 16
TILE = 128
CELLS = 1 << 20

# Fixed value of the contract: a term is a run of other bytes than these.
INNER = np.ones(256, bool)
for _low, _high in ((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    INNER[_low : _high + 1] = False

BLOCKS = pa.schema(
    [
        ("block", pa.int64()),
        ("lang", pa.string()),
        ("term", pa.binary()),
        ("docs", pa.list_(pa.int32())),
        ("sources", pa.list_(pa.string())),
        ("counts", pa.list_(pa.int64())),
    ]
)
BLOCK_DDL = "block long, lang string, term binary, docs array<int>, sources array<string>, counts array<long>"


def _runs(key: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


def _encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _terms_by_text(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text, term, occurrences) of the texts' distinct terms, piece by piece; a term is never cut.

    A text longer than a piece has several rows for a term.
    """
    texts, terms, counts = [], [], []
    lo = 0
    while lo < len(data):
        hi = min(lo + PIECE_BYTES, len(data))
        if hi < len(data):  # back to the last byte outside a term, or on to the next one
            outside = np.flatnonzero(~INNER[data[lo:hi]])
            if len(outside):
                hi = lo + int(outside[-1]) + 1
            while hi < len(data) and not len(outside):
                more = np.flatnonzero(~INNER[data[hi : hi + PIECE_BYTES]])
                hi, outside = (hi + int(more[0]) + 1, more) if len(more) else (min(hi + PIECE_BYTES, len(data)), more)
        byte = LOWER[data[lo:hi]]
        inside = INNER[byte]
        edge = np.zeros(hi - lo + 1, bool)
        edge[bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi, "right")] - lo] = True
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        finishes[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        if len(starts):
            offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
            held = pa.Array.from_buffers(
                pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(byte[inside])]
            )
            code, names = _encoded(held)
            text = np.searchsorted(bounds, starts + lo, "right") - 1
            key, n = np.unique(text * len(names) + code, return_counts=True)
            texts.append(key // len(names))
            terms.append(names.take(pa.array(key % len(names))))
            counts.append(n)
        lo = hi
    if not texts:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    return np.concatenate(texts), pa.concat_arrays(terms), np.concatenate(counts)


def _lists(starts: np.ndarray, total: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, total).astype(np.int32)), values)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of documents, language and term: the documents that hold it and its count by source."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        langs, sources, texts = batch.columns
        for part in text_slices(texts, BLOCK_BYTES):
            block += 1
            text, names, n = _terms_by_text(part.data, part.bounds)
            if not len(text):
                continue
            lang, lang_names = _encoded(langs.slice(part.lo, part.hi - part.lo))
            source, source_names = _encoded(sources.slice(part.lo, part.hi - part.lo))
            term, names = _encoded(names)
            by = np.lexsort((text, source[text], term, lang[text]))
            text, n = text[by], n[by]
            group = lang[text] * len(names) + term[by]
            origin = source[text]
            heads = _runs(group)
            # Documents of a term; the pieces of a long text name it more than once.
            docs = _runs(group * (part.hi - part.lo) + text)
            # Occurrences of a term in each source.
            cells = _runs(group * len(source_names) + origin)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(heads), block)),
                    lang_names.take(pa.array(group[heads] // len(names))),
                    names.take(pa.array(group[heads] % len(names))).cast(pa.binary()),
                    _lists(np.searchsorted(docs, heads), len(docs), pa.array(text[docs].astype(np.int32))),
                    _lists(np.searchsorted(cells, heads), len(cells), source_names.take(pa.array(origin[cells]))),
                    _lists(np.searchsorted(cells, heads), len(cells), pa.array(np.add.reduceat(n, cells))),
                ],
                schema=BLOCKS,
            )


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, prefix, documents) of each run of rows with equal block, language and prefix.

    The last run of a batch waits for the next one, as it may go on there.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        block, lang, prefix = batch.column(0).to_numpy(), *(_encoded(batch.column(i))[0] for i in (1, 2))
        last = np.flatnonzero((block != block[-1]) | (lang != lang[-1]) | (prefix != prefix[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut or (waiting and any(waiting[-1].column(i)[-1] != batch.column(i)[0] for i in range(3))):
            yield from _counted([*waiting, batch.slice(0, cut)])
            waiting = []
        waiting.append(batch.slice(cut))
    yield from _counted(waiting)


def _counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not sum(batch.num_rows for batch in held):
        return
    block, langs, prefixes, docs = (pa.concat_arrays([b.column(i) for b in held]) for i in range(4))
    lang, prefix = _encoded(langs)[0], _encoded(prefixes)[0]
    block = block.to_numpy()
    changed = (block[1:] != block[:-1]) | (lang[1:] != lang[:-1]) | (prefix[1:] != prefix[:-1])
    run = np.concatenate(([0], np.cumsum(changed)))
    heads = np.concatenate(([0], np.flatnonzero(changed) + 1))
    of = np.repeat(run, pc.list_value_length(docs).to_numpy())
    distinct = np.unique(of << 32 | docs.flatten().to_numpy().astype(np.int64)) >> 32
    yield pa.RecordBatch.from_arrays(
        [langs.take(pa.array(heads)), prefixes.take(pa.array(heads)), pa.array(np.bincount(distinct, minlength=len(heads)))],
        names=["lang", "prefix", "docs"],
    )


def _spot(key: str) -> Column:
    """Place of a language and a key among the bits of a filter."""
    return F.pmod(F.xxhash64("lang", key), F.lit(WORDS * 64))


def bit_filter(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits) of a filter that holds all given keys: at most WORDS rows, whatever is in it."""
    spot = keys.select(_spot(key).alias("spot"))
    bit = F.expr("shiftleft(1L, cast(spot & 63 as int))")
    return spot.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def passing(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows whose key may be in the filter: all that are, and by chance a few others.

    The filter is broadcast; its size is bounded by WORDS. The more keys it holds
    the more other rows pass, which costs time and changes no result.
    """
    spot = rows.withColumn("spot", _spot(key))
    found = spot.join(F.broadcast(bits), F.shiftright("spot", 6) == F.col("word"))
    return found.where("shiftright(bits, cast(spot & 63 as int)) & 1 = 1").select(*rows.columns)


def frequent_terms(blocks: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term) of all terms in ``least`` or more documents of their language.

    A level's prefix of a term is cut from the term with an end byte, which no term
    holds; so a prefix that contains it is a complete term. A block counts each of its
    documents once for a prefix; as a document lies in one block, these counts add up.
    Where the rows of a block are read by two tasks, a prefix between them may count a
    document twice and so stay a level longer; a complete term is one row of its block.

    Prefixes below ``least`` are discarded with all terms under them, complete terms of
    the others are kept, and the terms under the rest go on with prefixes twice as long,
    until nothing is left. Which terms go on is asked from a bit filter of bounded size
    where the rows are read, so that what is discarded is not shuffled.
    """
    complete, opened, length = [], blocks, FIRST_PREFIX
    ended = F.concat(F.col("term"), F.lit(b"\x00"))
    while True:
        nodes = opened.select("block", "lang", F.substring(ended, 1, length).alias("prefix"), "docs")
        counted = nodes.mapInArrow(_nodes, "lang string, prefix binary, docs long")
        frequent = counted.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        whole = F.substring("prefix", -1, 1) == F.lit(b"\x00")
        frequent = stored(frequent.select("lang", "prefix", whole.alias("whole")), "prefixes")
        term = F.expr("substring(prefix, 1, octet_length(prefix) - 1)").alias("term")
        complete.append(frequent.where("whole").select("lang", term))
        extended = frequent.where("NOT whole")
        if extended.isEmpty():
            break
        longer = blocks.where(F.octet_length("term") >= length).withColumn("prefix", F.substring(ended, 1, length))
        opened = passing(longer, "prefix", bit_filter(extended, "prefix"))
        length *= 2
    out = complete[0]
    for more in complete[1:]:
        out = out.unionByName(more)
    return out


def _share(count: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact for any counts."""
    over = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, (F.col("total") + F.col("kept")).cast("decimal(38,0)"))


def _by_idx(values: pa.ChunkedArray) -> np.ndarray:
    return values.to_numpy().astype(np.int64)


PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _compared(terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of one slice of terms for all pairs of a source on the left and one on the right.

    ``terms`` holds the shares of sources that have a term; ``sources`` those of all
    sources for a term they lack, and how many kept terms the slice has.
    """
    if sources.num_rows == 0:
        return PAIRS.empty_table()
    lang = sources.column("lang")[0].as_py()
    sides = []
    for side in ("left", "right"):
        held = sources.filter(sources.column(side))
        sides.append((_by_idx(held.column("idx")), held.column("source").combine_chunks(), _by_idx(held.column("absent"))))
    (li, left, p0), (ri, right, q0) = sides
    term, names = _encoded(terms.column("term").combine_chunks())
    at, share = _by_idx(terms.column("holder")), _by_idx(terms.column("p"))

    def places(idx: np.ndarray) -> np.ndarray:
        """Place of each row's source on a side; -1 where it is not on it."""
        order = np.argsort(idx)
        found = np.minimum(np.searchsorted(idx[order], at), len(idx) - 1)
        place = order[found]
        return np.where(idx[place] == at, place, -1)

    lp, rp = places(li), places(ri)
    total = np.zeros((len(li), len(ri)), np.int64)
    by = np.argsort(term, kind="stable")
    term, lp, rp, share = term[by], lp[by], rp[by], share[by]
    step = max(1, CELLS // (len(li) * len(ri)))
    for lo in range(0, len(names), step):
        hi = min(lo + step, len(names))
        here = slice(np.searchsorted(term, lo), np.searchsorted(term, hi))
        p = np.broadcast_to(p0, (hi - lo, len(li))).copy()
        q = np.broadcast_to(q0, (hi - lo, len(ri))).copy()
        for grid, place in ((p, lp[here]), (q, rp[here])):
            on = place >= 0
            grid[term[here][on] - lo, place[on]] = share[here][on]
        gap = p[:, :, None] - q[:, None, :]
        total += (gap * gap // q[:, None, :]).sum(axis=0)
    # Terms of the slice that none of these sources has.
    gap = p0[:, None] - q0[None, :]
    total += (int(sources.column("terms")[0].as_py()) - len(names)) * (gap * gap // q0[None, :])
    i, j = np.nonzero(li[:, None] != ri[None, :])
    return pa.table(
        [
            pa.array([lang] * len(i), pa.string()),
            left.take(pa.array(i)),
            right.take(pa.array(j)),
            pa.array(total[i, j]),
        ],
        schema=PAIRS,
    )


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """How each (lang, source) group differs from the language's other sources and from the language.

    Returns lang, source, part, item, value, rank. Part ``pair``: item is another source
    of the language, value the sum over all kept terms of floor((p - q)^2 / q). Part
    ``term``: item is a term more frequent in the group than in the language, with its
    own value; the ``top`` first ones. Ranks run from 1 in each group and part, by value
    descending, then item by its bytes.

    1. Texts are cut into terms once: for each block of documents, language and term, the
       documents that hold it and its occurrences by source, written to the shared folder.
    2. :func:`frequent_terms` keeps what is in ``least`` documents or more.
    3. Shares p and q are whole numbers, computed with decimals.
    4. Slices of terms, by hash, are compared for tiles of 128 sources at a time, so that
       no row is made for a pair and a term; the sums of slices are added up.

    Null text, lang and source read as empty; each is a group like any other. Rows with
    equal ids are different documents. A group without kept terms has its pairs, with
    values by the same formula; if the language keeps no term they are 0. Extra columns are
    ignored. Very long texts are read in pieces. An empty table gives no rows.
    """
    rows = pick(docs, lang="string", source="string", text="string").fillna("")
    blocks = stored(rows.mapInArrow(_blocks, BLOCK_DDL), "term-blocks")
    kept = frequent_terms(blocks, least)
    held = passing(blocks.select("lang", "term", "sources", "counts"), "term", bit_filter(kept, "term"))
    cells = held.select("lang", "term", F.inline(F.arrays_zip("sources", "counts")))
    counts = cells.groupBy("lang", F.col("sources").alias("source"), "term").agg(F.sum("counts").alias("n"))
    counts = stored(counts.join(kept, ["lang", "term"], "left_semi"), "term-counts")
    forget(blocks, kept)

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("holders"))
    whole = stored(whole, "language-terms")
    langs = whole.groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("n").alias("total"), F.sum("holders").alias("rows")
    )
    langs = stored(langs.withColumn("salts", F.ceil(F.col("rows") / ROWS_A_SALT).cast("int")), "languages")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        rows.select("lang", "source")
        .distinct()
        .join(totals, ["lang", "source"], "left")
        .join(langs.select("lang", "kept", "salts"), "lang", "left")
        .fillna({"total": 0, "kept": 0, "salts": 1})
        .withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        .withColumn("absent", F.when(F.col("kept") > 0, _share(F.lit(0))).otherwise(1))
    )
    groups = stored(groups, "source-groups")
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "salts", "idx", _share(F.col("n")).alias("p"))
    return _pairs(shares, groups, whole, langs).unionByName(_terms(shares, whole, langs, top))


def _salt() -> Column:
    return F.pmod(F.xxhash64("term"), F.col("salts")).cast("int").alias("salt")


def _pairs(shares: DataFrame, groups: DataFrame, whole: DataFrame, langs: DataFrame) -> DataFrame:
    tile = F.floor(F.col("idx") / TILE).cast("int")
    last = groups.groupBy("lang").agg(F.floor(F.max("idx") / TILE).cast("int").alias("last"))

    def tiled(rows: DataFrame) -> DataFrame:
        """Each row once for every tile, a pair of source ranges, that its source is on a side of."""
        own = F.struct(tile.alias("i"), tile.alias("j"))
        others = F.expr("filter(sequence(0, last), x -> x <> tile)")
        beside = F.flatten(
            F.transform(others, lambda x: F.array(F.struct(tile.alias("i"), x.alias("j")), F.struct(x.alias("i"), tile.alias("j"))))
        )
        wide = rows.join(last, "lang").withColumn("tile", tile)
        return wide.select("*", F.inline(F.concat(F.array(own), beside))).withColumns(
            {"left": F.col("tile") == F.col("i"), "right": F.col("tile") == F.col("j")}
        )

    sizes = whole.join(langs.select("lang", "salts"), "lang").groupBy("lang", _salt()).agg(F.count(F.lit(1)).alias("terms"))
    slices = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    slices = slices.join(sizes, ["lang", "salt"], "left").fillna({"terms": 0})
    key = ["lang", "salt", "i", "j"]
    held = tiled(shares.select("lang", "term", "idx", "p", _salt())).select(*key, "term", F.col("idx").alias("holder"), "p")
    asked = tiled(slices).select(*key, "source", "idx", "absent", "terms", "left", "right")
    made = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(
        _compared, "lang string, source string, item string, value long"
    )
    return _ranked(made.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")


def _terms(shares: DataFrame, whole: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    language = whole.join(langs, "lang").select("lang", "term", _share(F.col("n")).alias("q"))
    p, q = F.col("p"), F.col("q")
    value = F.call_function("div", (p - q) * (p - q), q).alias("value")
    more = shares.join(language, ["lang", "term"]).where(p > q)
    rows = more.select("lang", "source", F.col("term").cast("string").alias("item"), value)
    return _ranked(rows, "term").where(F.col("rank") <= top)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
