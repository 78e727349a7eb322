import random
from itertools import permutations

import numpy as np
import pytest

from samples import LONG, odd_rows, sentence
from logsluice.llm import transducer
from logsluice.llm.filteraudit import filter_interactions, text_measures

SPACES = " \t\n\x0b\f\r"


def plain(text):
    words = [w for w in "".join(" " if c in SPACES else c for c in text or "").split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text or "")
    return (len(words), len(set(words)), capitals, len(text or ""), sum(c in "#$%&*|" for c in text or ""))


def bytes_of(texts):
    held = [t.encode() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in held]))).astype(np.int64)
    return np.frombuffer(b"".join(held), np.uint8), bounds


@pytest.mark.parametrize("piece", [1, 3, 7, 64, 1 << 20])
def test_transducer_in_pieces(piece):
    rng = random.Random(piece)
    texts = ["".join(rng.choice("aAbé中\U0001f600 \t\n|#") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["", "", "word", " ", "Aa Aa aA", "x" * 9000 + " " + "x" * 9000 + "y " + "x" * 9000]
    found = transducer.measure(*bytes_of(texts), piece=piece)
    assert list(zip(*found.tolist(), strict=True)) == [plain(t) for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(transducer, "mix", lambda x: x & np.uint64(3))
    texts = [sentence(1, 3000) + " " + sentence(1, 500), sentence(2, 2000), LONG[:20000]]
    found = transducer.measure(*bytes_of(texts), piece=5000)
    assert list(zip(*found.tolist(), strict=True)) == [plain(t) for t in texts]


def test_measures_of_given_texts(small):
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for r in text_measures(small).collect():
        assert tuple(r[m] for m in transducer.MEASURES) == plain(texts[r["doc_id"]])


def audit(rows, marks):
    """The audit document by document, order by order."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, lang, *_ in rows:
        words, distinct, capitals, points, symbols = plain(text)
        fails = {x for x, on in zip("ABCDE", (
            words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * points, symbols > 0,
            i is not None and first[text or ""] < i), strict=True) if on}
        docs.append((lang or "", fails, *marks.get(i, (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                failing = sum(x in d[1] for d in mine)
                out[part, order, step] = [
                    len(left), len(gone), failing - len(gone), sum(d[1] == {x} for d in mine),
                    sum(d[2] == 1 for d in gone), sum(d[3] == 1 for d in gone)]
        for x in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == x)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == x:
                    v.append(total)
    return out


def test_audit_against_brute_force(spark, odd, nothing):
    rows = odd_rows() + [(100 + i, sentence(i, 150) if i % 3 else "SHOUTS # " * 20, "en", "a", 0) for i in range(30)]
    rows += [(200 + i, sentence(i, 150), "en" if i % 2 else None, "b", 0) for i in range(12)]
    marks = {i: (i % 2, i % 3 // 2) for i in range(0, 220, 2)} | {105: (1, None)}
    labels = spark.createDataFrame([(k, *v) for k, v in marks.items()] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = filter_interactions(docs.withColumn("fails", docs["text"]).withColumn("sha", docs["text"]), labels)
    got = {tuple(r)[:3]: list(r)[3:] for r in found.collect()}
    assert got == audit(rows, marks)
    assert len(filter_interactions(odd, labels).collect()) == 600 * 3
    assert filter_interactions(nothing, labels).count() == 0
