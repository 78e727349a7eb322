"""Language-model scores from a class-based bigram model (Brown classes by exchange)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import held_out, pick, stored
from logsluice.llm.hashing import Words, mix, text_slices, words_of

CLASSES = 96
# Words that are clustered one by one; every other word is clustered with its ending.
OWN_UNITS = 3000
ENDINGS = 1024
ROUNDS = 12
# One in so many units moves in a round.
TURNS = 4
# Words whose counts every task holds; the counts of all others are joined.
HELD = 1 << 19
DISCOUNT = 0.75
BACKOFF = 4.0
END = np.uint64(0x454E44)


@dataclass
class Units:
    """What is clustered: frequent words, endings (last two bytes, hashed), and the text's end."""

    own: np.ndarray  # sorted word hashes

    @property
    def count(self) -> int:
        return len(self.own) + ENDINGS + 1

    @property
    def end(self) -> int:
        return len(self.own) + ENDINGS

    def of(self, words: Words) -> np.ndarray:
        return self.of_hashes(words.hashes, endings(words))

    def of_hashes(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The units of words given by hash and ending; an ending of -1 is the end itself."""
        unit = np.where(ends < 0, self.end, len(self.own) + ends)
        if len(self.own) and len(hashes):
            at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
            unit = np.where(self.own[at] == hashes, at, unit)
        return unit


def endings(words: Words) -> np.ndarray:
    """The last two bytes of each word, as one of ENDINGS numbers."""
    if not len(words.ends):
        return np.zeros(0, np.int64)
    last = words.data[words.ends - 1].astype(np.uint64)
    near = words.data[np.maximum(words.ends - 2, 0)].astype(np.uint64)
    near[words.ends - words.starts == 1] = 0
    return (mix(last * np.uint64(256) + near) % np.uint64(ENDINGS)).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sequence(words: Words, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """``values`` with ``end`` after each row, and the row of each."""
    rows = len(words.rows) - 1
    out = np.insert(values, words.rows[1:], end)
    return out, np.repeat(np.arange(rows), words.counts() + 1)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch.column(0)):
            words = words_of(part)
            found, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(np.append(found, END)),
                    pa.array(np.append(endings(words)[first], -1)),
                    pa.array(np.append(n, part.hi - part.lo).astype(np.int64)),
                ],
                ["h", "e", "n"],
            )


def _pairs(values: np.ndarray, of: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each value with the one before it in its row; ``end`` stands before the first."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    first = np.ones(len(values), bool)
    first[1:] = of[1:] != of[:-1]
    before[first] = end
    return before, values


def exchange(bigrams: DataFrame, start: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Assigns units to classes so that class bigrams tell as much as they can.

    ``bigrams`` (a, b, n) counts neighbouring units. In each round Spark sums, for every
    unit, its counts with the classes before and after it; each unit is then weighed in
    each class by the gain in the sum of n log n over class pairs and classes, the
    counts being those without the unit. One in TURNS units moves in a round, so that few
    of a unit's neighbours move with it. It ends when no unit has moved for TURNS rounds. Only units x classes sums reach the driver,
    whatever the size of the corpus.
    """
    units, assigned, still = len(start), start.copy(), 0
    for turn in range(rounds):
        current = assigned.copy()

        def add(batches, current=current):
            for batch in batches:
                a, b, n = (c.to_numpy() for c in batch.columns)
                right = np.bincount(a * classes + current[b], n, units * classes)
                left = np.bincount(b * classes + current[a], n, units * classes)
                for side, sums in enumerate((right, left)):
                    at = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), side, np.int32)),
                            pa.array(at),
                            pa.array(sums[at].astype(np.int64)),
                        ],
                        ["side", "k", "n"],
                    )

        sums = bigrams.mapInArrow(add, "side int, k long, n long").groupBy("side", "k").agg(F.sum("n").alias("n"))
        got = sums.toArrow()  # at most 2 x units x classes rows
        both = np.zeros((2, units * classes))
        both[got["side"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
        right, left = both.reshape(2, units, classes)
        table = np.zeros((classes, classes))
        np.add.at(table, assigned, right)
        moved = 0
        for u in range(turn % TURNS, units, TURNS):
            if not (right[u].any() or left[u].any()):
                continue
            own = assigned[u]
            table[own] -= right[u]
            table[:, own] -= left[u]
            gain = (_nlogn(table + right[u]) - _nlogn(table)).sum(axis=1)
            gain += (_nlogn(table + left[u][:, None]) - _nlogn(table)).sum(axis=0)
            sizes, ends = table.sum(axis=1), table.sum(axis=0)
            gain -= _nlogn(np.maximum(sizes + right[u].sum(), 0)) - _nlogn(np.maximum(sizes, 0))
            gain -= _nlogn(np.maximum(ends + left[u].sum(), 0)) - _nlogn(np.maximum(ends, 0))
            best = int(gain.argmax())
            best = best if gain[best] > gain[own] + 1e-9 else own
            table[best] += right[u]
            table[:, best] += left[u]
            moved += best != own
            assigned[u] = best
        still = 0 if moved else still + 1
        if still == TURNS:
            break
    return assigned


def _nlogn(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-9)), 0.0)


@dataclass
class Model:
    """Everything a task needs; its size does not depend on the corpus.

    ``step[c, d]`` is log10 P(class d after class c). A word in class d with count n has
    P(word | d) = (n - DISCOUNT) / size of d; a word that was never seen stands
    for the rest of its class, at least one count.
    """

    units: Units
    classes: np.ndarray
    step: np.ndarray
    total: int
    kinds: int
    end_count: int
    sizes: np.ndarray
    unseen: np.ndarray
    held: np.ndarray
    held_n: np.ndarray

    def emission(self, cls: np.ndarray, n: np.ndarray) -> np.ndarray:
        mass = np.where(n > 0, n - DISCOUNT, self.unseen[cls])
        return np.log10(mass) - np.log10(self.sizes[cls])

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10(n + 1.0) - np.log10(float(self.total) * 1.0 + self.kinds + 1.0)


def fit(train: DataFrame, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """Fits on all rows of ``train`` (text); returns the model and the counts of all words (h, e, n).

    1. Counts of all words, by 64-bit hash: written to the shared folder.
    2. Neighbour counts of units, over all words: a word is its own unit when it is
       among the OWN_UNITS most frequent, else it belongs to its ending.
    3. Exchange clustering of the units.
    4. Class bigrams follow from the unit bigrams; class sizes and kinds, for the
       emissions, from the word counts of each class.
    """
    counts = stored(
        train.select("text")
        .mapInArrow(_word_counts, "h long, e long, n long")
        .groupBy("h", "e")
        .agg(F.sum("n").alias("n")),
        "word-counts",
    )
    total, kinds, ends = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1)), F.sum(F.when(F.col("e") < 0, F.col("n")))
    ).first()
    # How many words have a count of about so much: at most some hundred rows.
    step_of = F.floor(F.log2("n") * 8).cast("int")
    words_only = counts.where("e >= 0")
    sizes_of = words_only.groupBy(step_of.alias("s")).count().orderBy(F.desc("s")).collect()
    least, room = 1 << 30, HELD
    for level, many in sizes_of:
        if many > room:
            break
        least, room = level, room - many
    top = words_only.where(step_of >= least).select("h", "n").toArrow()  # at most HELD rows
    top_h, top_n = np.ascontiguousarray(top["h"].to_numpy()).view(np.uint64), top["n"].to_numpy()
    first = np.lexsort((top_h, -top_n))[:OWN_UNITS]
    units = Units(np.sort(top_h[first]))
    order = np.argsort(top_h)
    end = units.end

    def unit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(0)):
                words = words_of(part)
                seq, of = _sequence(words, units.of(words), end)
                a, b = _pairs(seq, of, end)
                k, n = np.unique(a * units.count + b, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k // units.count), pa.array(k % units.count), pa.array(n.astype(np.int64))],
                    ["a", "b", "n"],
                )

    bigrams = stored(
        train.select("text")
        .mapInArrow(unit_pairs, "a long, b long, n long")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n")),
        "unit-bigrams",
    )
    # Frequent words begin in classes of their own, the rest in turn; the end has one to itself.
    start = np.arange(units.count) % (classes - 1) + 1
    start[np.searchsorted(units.own, top_h[first])] = np.arange(len(first)) % (classes - 1) + 1
    start[end] = 0
    assigned = exchange(bigrams.where((F.col("a") != end) & (F.col("b") != end)), start, classes)
    assigned[end] = 0
    # The end's class may hold nothing else.
    assigned[:end] = np.maximum(assigned[:end], 1)

    def class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(classes * classes)
        for batch in batches:
            a, b, n = (c.to_numpy() for c in batch.columns)
            table += np.bincount(assigned[a] * classes + assigned[b], n, classes * classes)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].astype(np.int64))], ["k", "n"])

    got = bigrams.mapInArrow(class_pairs, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(classes * classes)
    table[got["k"].to_numpy()] = got["n"].to_numpy()
    table = table.reshape(classes, classes)
    share = (table.sum(axis=0) + 1) / (table.sum() + classes)
    step = (table + BACKOFF * share) / (table.sum(axis=1, keepdims=True) + BACKOFF)

    def class_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(classes, np.int64)
        for batch in batches:
            h, e = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint64), batch.column(1).to_numpy()
            seen += np.bincount(assigned[units.of_hashes(h, e)], minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(seen)], ["c", "n"])

    class_words = counts.select("h", "e").mapInArrow(class_kinds, "c long, n long").groupBy("c").agg(F.sum("n"))
    kinds_of = {r[0]: r[1] for r in class_words.collect()}  # one row for each class
    in_class = np.array([kinds_of.get(c, 0) for c in range(classes)], float)
    in_class[0] = 1
    sizes = np.maximum(table.sum(axis=0), 0)
    unseen = np.maximum(in_class * DISCOUNT, 1.0)
    sizes = np.where(sizes > 0, sizes - in_class * DISCOUNT + unseen, 1.0)
    return (
        Model(
            units, assigned, np.log10(step), int(total), int(kinds), int(ends or 0), sizes, unseen, top_h[order], top_n[order]
        ),
        counts,
    )


SCORED = "rid long, doc_id long, n_tokens long, n_known long, base double, score double, rest array<struct<h:long,c:int,n:long>>"


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        rid = TaskContext.get().partitionId() << 40
        kinds = pa.struct([("h", pa.int64()), ("c", pa.int32()), ("n", pa.int64())])
        end_n = np.array([model.end_count])
        for batch in batches:
            for part in text_slices(batch.column(1)):
                rows = part.hi - part.lo
                words = words_of(part)
                cls = model.classes[model.units.of(words)]
                seq, of = _sequence(words, cls, 0)
                a, b = _pairs(seq, of, 0)
                score = np.bincount(of, model.step[a, b], rows)
                row = words.row_of()
                kind, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
                if len(model.held):
                    at = np.minimum(np.searchsorted(model.held, kind), len(model.held) - 1)
                    n = np.where(model.held[at] == kind, model.held_n[at], 0)
                else:
                    n = np.zeros(len(kind), np.int64)
                held, kc = n > 0, cls[first]
                score += np.bincount(row, np.where(held, model.emission(kc, n), 0.0)[back], rows)
                score += model.emission(np.zeros(1, np.int64), end_n)[0]
                base = np.bincount(row, np.where(held, model.base(n), 0.0)[back], rows) + model.base(end_n)[0]
                known = np.bincount(row, held[back], rows).astype(np.int64) + int(model.end_count > 0)
                rare = np.flatnonzero(~held[back])
                pairs, many = np.unique(row[rare] * max(len(kind), 1) + back[rare], return_counts=True)
                pr, pk = pairs // max(len(kind), 1), pairs % max(len(kind), 1)
                rest = pa.StructArray.from_arrays(
                    [_signed(kind[pk]), pa.array(kc[pk].astype(np.int32)), pa.array(many.astype(np.int64))],
                    fields=list(kinds),
                )
                bounds = np.searchsorted(pr, np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid + np.arange(rows)),
                        batch.column(0).slice(part.lo, rows),
                        pa.array(words.counts() + 1),
                        pa.array(known),
                        pa.array(base),
                        pa.array(score),
                        pa.ListArray.from_arrays(pa.array(bounds), rest),
                    ],
                    ["rid", "doc_id", "n_tokens", "n_known", "base", "score", "rest"],
                )
                rid += rows

    return score


def score_documents(docs: DataFrame, classes: int = CLASSES) -> DataFrame:
    """log10 probabilities of all documents under a class bigram model of the corpus.

    Needs ``doc_id`` and ``text``; other columns are ignored. Learns from all rows with
    crc32(doc_id) mod 7 other than 2. Returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (add-one unigrams) and score:
    P(w after v) = P(class of w | class of v) P(w | class of w).

    A task holds the counts of at most HELD frequent words; rarer words of a
    document, each once with its number, are joined with the counts of all words.
    Word counts and neighbour counts cover the whole corpus.

    A null or empty text is the end token alone. A null doc_id is trained on; repeated
    rows are scored one by one. A very long text is one slice of a task (about 100
    bytes of memory for each byte). Without training rows every token is unseen.
    An empty table gives no rows.
    """
    base = pick(docs, doc_id="long", text="string")
    model, counts = fit(base.where(~held_out(F.col("doc_id"), 7, 2)), classes)
    shared = base.sparkSession.sparkContext.broadcast(model)  # HELD words and classes x classes numbers
    scored = stored(base.mapInArrow(_score(shared), SCORED), "scored")

    def by_class(values) -> Column:
        return F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("r.c") + 1)

    norm = float(np.log10(float(model.total) + model.kinds + 1.0))
    n = F.coalesce(counts["n"], F.lit(0))
    rest = (
        scored.select("rid", F.explode("rest").alias("r"))
        .join(counts, F.col("r.h") == counts["h"], "left")
        .groupBy(F.col("rid").alias("__rid"))
        .agg(
            F.sum(F.when(n > 0, F.col("r.n")).otherwise(0)).alias("__known"),
            F.sum(F.col("r.n") * (F.log10(n + 1.0) - norm)).alias("__base"),
            F.sum(
                F.col("r.n")
                * (F.log10(F.when(n > 0, n - DISCOUNT).otherwise(by_class(model.unseen))) - F.log10(by_class(model.sizes)))
            ).alias("__score"),
        )
    )

    def plus(name: str, other: str):
        return (F.col(name) + F.coalesce(F.col(other), F.lit(0))).alias(name)

    return (
        scored.drop("rest")
        .join(rest, F.col("rid") == F.col("__rid"), "left")
        .select(
            "doc_id",
            held_out(F.col("doc_id"), 7, 2).alias("held_out"),
            "n_tokens",
            plus("n_known", "__known"),
            F.lit(model.total).cast("long").alias("train_tokens"),
            plus("base", "__base").alias("base_score"),
            plus("score", "__score"),
        )
    )
