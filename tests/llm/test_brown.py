import math
import zlib
from collections import Counter

import numpy as np
import pytest

import brute
from samples import odd_rows
from logsluice.llm import brown
from logsluice.llm.brown import exchange, score_documents

END = "\0end"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check_base(found, rows):
    tokens = [(i, [*brute.words(t), END]) for i, t in rows]
    counts = Counter(w for i, t in tokens if not held(i) for w in t)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), held(i), len(t), sum(counts[w] > 0 for w in t), total,
         round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t), 6))
        for i, t in tokens
    )
    got = sorted(
        (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
        for r in found
    )
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-5) for g, w in zip(got, want, strict=True))


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs.collect(), score_documents(docs).collect()


def test_counts_and_base_scores(scored):
    docs, found = scored
    check_base(found, [(r["doc_id"], r["text"]) for r in docs])


def test_held_out_texts_score_better_than_unigrams(scored):
    _, found = scored
    for part in (True, False):
        rows = [r for r in found if r["held_out"] == part]
        assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_joined_counts_give_the_same_scores(spark, scored, monkeypatch):
    monkeypatch.setattr(brown, "HELD", 500)
    monkeypatch.setattr(brown, "OWN_UNITS", 400)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = score_documents(docs).collect()
    check_base(found, [(r["doc_id"], r["text"]) for r in scored[0]])


def test_probabilities_after_a_class_sum_to_one(small):
    model, counts = brown.fit(small, classes=12)
    assert np.allclose((10.0**model.step).sum(axis=1), 1)
    rows = counts.collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    n, e = np.array([r["n"] for r in rows]), np.array([r["e"] for r in rows])
    cls = model.classes[model.units.of_hashes(h, e)]
    seen = np.bincount(cls, 10.0 ** model.emission(cls, n), 12)
    every = np.arange(12)
    unseen = 10.0 ** model.emission(every, np.zeros(12, np.int64))
    used = np.bincount(cls, minlength=12) > 0
    assert np.allclose((seen + unseen)[used], 1)
    assert n.sum() == model.total and len(rows) == model.kinds


def test_exchange_finds_the_classes_of_alternating_words(spark):
    rng = np.random.default_rng(4)
    # Three kinds of words that follow each other in a ring; kinds and numbers are unrelated.
    kinds, pairs = rng.permutation(60) % 3, Counter()
    words = [np.flatnonzero(kinds == k) for k in range(3)]
    for _ in range(20_000):
        kind = rng.integers(3)
        pairs[int(rng.choice(words[kind])), int(rng.choice(words[(kind + 1) % 3]))] += 1
    rows = [(a, b, n) for (a, b), n in pairs.items()]
    bigrams = spark.createDataFrame(rows, "a long, b long, n long")
    start = np.arange(60) % 4
    found = exchange(bigrams, start, 4, rounds=20)

    def told(classes):
        table = np.zeros((4, 4))
        for a, b, n in rows:
            table[classes[a], classes[b]] += n
        return (
            brown._nlogn(table).sum() - brown._nlogn(table.sum(axis=0)).sum() - brown._nlogn(table.sum(axis=1)).sum()
        )

    assert told(found) > told(start) + 0.95 * (told(kinds) - told(start))


def test_scores_equal_a_plain_pass_over_the_model(small, texts):
    found = {r["doc_id"]: r["score"] for r in score_documents(small).collect()}
    from pyspark.sql import functions as F

    from logsluice.llm.common import held_out
    from logsluice.llm.hashing import text_slices, words_of

    import pyarrow as pa

    model, counts = brown.fit(small.where(~held_out(F.col("doc_id"), 7, 2)))
    n_of = {(r["h"] % 2**64): r["n"] for r in counts.collect()}
    for i, text in texts.items():
        words = words_of(next(text_slices(pa.array([text]))))
        total, before = 0.0, 0
        cls = model.classes[model.units.of(words)]
        for h, c in zip(words.hashes.tolist(), cls.tolist(), strict=True):
            n = n_of.get(h, 0)
            mass = n - brown.DISCOUNT if n else model.unseen[c]
            total += model.step[before, c] + math.log10(mass / model.sizes[c])
            before = c
        total += model.step[before, 0] + math.log10((model.end_count - brown.DISCOUNT) / model.sizes[0])
        assert math.isclose(total, found[i], rel_tol=1e-9)


def test_odd_rows(odd, nothing):
    found = score_documents(odd).collect()
    assert len(found) == 13
    check_base(found, [(r[0], r[1]) for r in odd_rows()])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert score_documents(nothing).count() == 0


def test_no_training_rows(spark):
    ids = [i for i in range(200) if held(i)]
    docs = spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string")
    found = score_documents(docs).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0.0 for r in found)
    assert all(math.isfinite(r["score"]) for r in found)
