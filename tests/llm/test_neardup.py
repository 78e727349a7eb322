import random

import numpy as np

import brute
from samples import odd_rows, sentence
from logsluice.llm import neardup
from logsluice.llm.hashing import text_slices, words_of
from logsluice.llm.neardup import chance_collisions, compress, estimate, near_duplicates, size_class, sketch


def check(found, texts):
    want = brute.near_groups(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_against_brute_force(small, texts):
    check(near_duplicates(small).collect(), texts)


def test_copies_around_the_threshold(spark):
    """Chains of edits of several lengths: some pairs just over, some just under 75 %."""
    rng, texts = random.Random(3), {}
    for base in range(40):
        words = sentence(base, rng.choice([3, 4, 6, 9, 20, 60, 150, 600])).split()
        for _ in range(rng.choice([1, 3, 8])):
            texts[len(texts)] = " ".join(words)
            words = list(words)
            for _ in range(max(1, int(len(words) * rng.choice([0.004, 0.02, 0.03])))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words = words[: max(1, int(len(words) * 0.87))]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(near_duplicates(docs).collect(), texts)


def test_large_group_without_a_common_hub(spark):
    """Every text shares one passage; copies differ from each other, in part by too much."""
    rng, texts = random.Random(5), {}
    passage = sentence(1, 80)
    for i in range(400):
        words = (passage + " " + sentence(2 if i % 2 else 1000 + i, 40)).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"y{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(near_duplicates(docs).collect(), texts)


def test_blocks_alone_find_all(spark, monkeypatch):
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    texts = {i: sentence(i % 3, 30 + i % 4) for i in range(60)}
    texts |= {100 + i: sentence(9, 90) + f" tail{i} end{i}" for i in range(50)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check([r for r in near_duplicates(docs).collect()], texts)


def test_blocks_alone_find_all_of_large_sets(spark, monkeypatch):
    """Classes 5 to 7, and neighbouring ones; every pair is one that shares bands."""
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    texts = {}
    for k, size in enumerate((150, 300, 800)):
        texts |= {100 * k + i: sentence(i % 3 + 10 * k, size + i % 4) for i in range(20)}
    # Either side of 256 and of 512 shingles.
    texts |= {400 + i: sentence(40, 250 + i) for i in range(20)}
    texts |= {500 + i: sentence(50, 500 + 2 * i) for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(near_duplicates(docs).collect(), texts)


def test_a_row_without_the_band_of_its_group_is_an_error():
    import pyarrow as pa
    import pytest

    registers = np.arange(2 * neardup.REGISTERS, dtype=np.uint16).reshape(2, -1).copy()
    registers[1] = registers[0]
    rows = {"rep": [1, 2], "component": [1, 2], "n": [600, 600], "regs": [r.tobytes() for r in registers]}
    types = {"kind": pa.array([7, 7], pa.int32()), "side": pa.array([0, 1], pa.int32()), "low": pa.nulls(2, pa.binary())}
    table = pa.table(rows | types)
    band = int(neardup.bands(registers[:1], 7)[0][0:1].view(np.int64)[0])
    place = (pa.scalar(0), pa.scalar(0))
    mark = {"band": band, "i": 0, "j": 0, "a": None, "b": None}
    more = pa.concat_tables([table] + [table.slice(1).set_column(0, "rep", pa.array([k])) for k in (3, 4, 5)])
    assert neardup._across((pa.scalar(band), *place), more).to_pylist() == [mark]
    alone = pa.concat_tables([table, table.slice(1, 1).set_column(1, "component", pa.array([1]))])
    assert neardup._across((pa.scalar(band), *place), alone).to_pylist() == [mark | {"a": 1, "b": 2}]
    with pytest.raises(ValueError, match="row 1 "):
        neardup._across((pa.scalar(band ^ 1), *place), table)


def test_links_of_a_block_are_those_of_all_pairs():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    for turn in range(30):
        base = rng.integers(1, 2**63, 40, dtype=np.uint64)
        sets = []
        for _ in range(25):
            keep = base[rng.random(40) < rng.choice([0.6, 0.85, 0.95])]
            own = rng.integers(1, 2**63, int(rng.integers(0, 9)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate((keep, own, base[:1]))))
        component = rng.integers(0, 18, 25)
        left, right = rng.random(25) < 0.7, rng.random(25) < 0.7
        table = pa.table({
            "rep": np.arange(25), "component": component, "left": left, "right": right,
            "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
        got = neardup._linked(table).to_pylist()
        linked = {
            (min(i, j), max(i, j))
            for i in np.flatnonzero(left)
            for j in np.flatnonzero(right)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
        }
        assert {(r["a"], r["b"]) for r in got} <= linked and len(got) <= len(set(component.tolist())) - 1

        def groups(pairs):
            root = {int(c): int(c) for c in component}
            for a, b in sorted(pairs):
                x, y = root[int(component[a])], root[int(component[b])]
                root = {c: min(x, y) if r in (x, y) else r for c, r in root.items()}
            return root

        assert groups({(r["a"], r["b"]) for r in got}) == groups(linked)


def test_a_group_of_many_likely_pairs_that_are_no_links(spark, monkeypatch):
    """Copies with so many edits of their own that most pairs lie between 0.55 and 0.75."""
    monkeypatch.setattr(neardup, "BLOCK", 60)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 4000)
    rng, texts, base = random.Random(8), {}, sentence(3, 150).split()
    for i in range(250):
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 5, 5, 6, 6])):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(near_duplicates(docs).collect(), texts)

def test_odd_rows(odd, nothing):
    found = near_duplicates(odd).collect()
    assert len(found) == 13
    got = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert got[2]["component_id"] == 1 and got[1]["kept"] and not got[2]["kept"]
    assert [got[i]["n_shingles"] for i in (3, 4, 5, 7)] == [0, 0, 0, 1]
    assert got[8]["n_shingles"] == len(brute.shingles(odd_rows()[8][1]))
    assert all(got[i]["kept"] for i in (1, 3, 4, 5, 6, 7, 8, 9, 10))
    assert all(r["kept"] and r["component_id"] is None for r in found if r["doc_id"] is None)
    assert near_duplicates(nothing).count() == 0


def test_words_and_their_hashes():
    import pyarrow as pa

    texts = ["The cat", None, " the\tCAT\vÄ ", "", "dog the"]
    words = words_of(next(text_slices(pa.array(texts))))
    cut = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert cut == ["the", "cat", "the", "cat", "Ä", "dog", "the"]
    assert list(words.counts()) == [2, 0, 3, 0, 2]
    h = words.hashes
    assert h[0] == h[2] == h[6] and h[1] == h[3] and len(set(h.tolist())) == 4


def test_compression_keeps_zeros_and_mantissa():
    values = np.array([1, 2**56, 2**56 - 1, 2**57 - 1, 3 << 20, 2**64 - 1], np.uint64)
    got = compress(values)
    for v, g in zip(values.tolist()[:-1], got.tolist(), strict=False):
        bits = bin(v)[3:] + "0" * 10
        assert g >> 10 == 57 - v.bit_length() and g & 1023 == int(bits[:10], 2)
    assert got[-1] == neardup.EMPTY


def test_estimates_are_close_and_corrected():
    rng = np.random.default_rng(2)
    for n in (5, 30, 200, 3000):
        errors = []
        for _ in range(40):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            shared = int(n * 0.8)
            a, b = pool[:n], np.concatenate((pool[:shared], pool[n : 2 * n - shared]))
            c = int(size_class(np.array([n]))[0])
            x, y = (sketch(s, np.zeros(len(s), np.int64), 1, c) for s in (a, b))
            size = np.array([n])
            errors.append(estimate(x, y, size, size, np.array([c]))[0] - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.03
    # Two unrelated sets: as many equal registers as the correction says.
    same = []
    for _ in range(300):
        pair = [sketch(rng.integers(0, 2**63, 2000, dtype=np.uint64), np.zeros(2000, np.int64), 1, 7) for _ in "ab"]
        same.append((pair[0] == pair[1]).mean())
    load = np.array([2000 / 128])
    assert abs(np.mean(same) - chance_collisions(load, load)[0]) < 2e-4
