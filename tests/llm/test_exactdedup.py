import hashlib
import random

import pytest

import brute
from samples import CLASHING, odd_rows
from logsluice.llm import exactdedup
from logsluice.llm.exactdedup import Chain, directory, drop_exact_duplicates, exact_duplicates


def check(found, rows):
    want = sorted(map(repr, brute.exact_groups([(r[0], r[1]) for r in rows])))
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"])) for r in found) == want


def test_against_brute_force_with_many_buckets(small):
    found = exact_duplicates(small, capacity=5).collect()
    check(found, small.collect())
    assert len({r["bucket"] for r in found}) > 30
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for r in found:
        norm = brute.SPACE.sub("", texts[r["doc_id"]])
        assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_odd_rows(odd, nothing):
    found = exact_duplicates(odd).collect()
    check(found, odd_rows())
    assert exact_duplicates(nothing).count() == 0
    kept = drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and set(CLASHING) < set(kept.columns)
    ids = [r["doc_id"] for r in kept.collect()]
    # The blank text with the most code points stays of 3, 4, 5 and the null row; 2 is repeated.
    assert sorted(ids, key=str) == sorted([1, 5, 6, 7, 8, None, 9, 10], key=str)


def test_all_rows_alike(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'same text' AS text")
    found = exact_duplicates(docs).collect()
    assert {(r["keep_id"], r["group_size"]) for r in found} == {(0, 5000)}
    assert sum(r["kept"] for r in found) == 1


def test_directory_doubles_and_shares_buckets():
    places = directory({0: 10, 1: 10, 8: 1, 15: 3}, capacity=10, max_depth=4)
    assert len(places) == 16
    assert places[0] != places[1]  # split down to the last bit
    assert len(set(places[8:])) == 1  # never split
    rng = random.Random(1)
    filled = {rng.randrange(256): rng.randrange(50) for _ in range(100)}
    places = directory(filled, 40, 8)
    for bucket in set(places):
        at = [p for p in range(256) if places[p] == bucket]
        assert at == list(range(at[0], at[-1] + 1)) and len(at) & (len(at) - 1) == 0
        assert len(at) == 1 or sum(filled.get(p, 0) for p in at) <= 40
    assert set(directory({}, 10, 3)) == {0}


def test_chain_compares_bytes_under_one_key():
    chain = Chain()
    for row in ([0, 7, "s", b"a", 1, 3, 5], [0, 7, "t", b"b", 1, 3, 4], [0, 7, "s", b"a", 1, 4, 9]):
        chain.add(row)
    assert [(x[3], x[4], x[6]) for x in chain.links] == [(b"a", 2, 9), (b"b", 1, 4)]


def test_colliding_keys_stay_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)], "doc_id long, text string")
    real = exactdedup.F.xxhash64
    monkeypatch.setattr(exactdedup.F, "xxhash64", lambda *c: real(exactdedup.F.lit(1)) if c == ("norm",) else real(*c))
    found = exact_duplicates(docs).collect()
    assert {(r["keep_id"], r["group_size"]) for r in found} == {(0, 10), (1, 10), (2, 10)}


@pytest.mark.parametrize("text", ["", None, "　"])
def test_single_text(spark, text):
    found = exact_duplicates(spark.createDataFrame([(4, text)], "doc_id long, text string")).collect()
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in found] == [(4, 1, True)]
