import numpy as np

from samples import sentence
from logsluice.llm import licenses
from logsluice.llm.licenses import TEMPLATES, align, build_index, scan_licenses

SCHEMA = "doc_id long, text string, license string, template string, start string"


def scan(spark, texts):
    rows = [(i, t, "x", "x", "x") for i, t in texts]
    return scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()


def test_every_template_is_found_whole(spark):
    texts, want = [], {}
    for name, wordings in TEMPLATES.items():
        for i, wording in enumerate(wordings):
            doc = len(texts)
            before = sentence(doc, 30)
            texts.append((doc, f"{before}. {wording.upper()} {sentence(doc + 50, 20)}"))
            want[doc, name, i] = (len(before) + 2, wording)
    got = {(r["doc_id"], r["license"], r["template"]): r for r in scan(spark, texts)}
    for key, (start, wording) in want.items():
        found = got[key]
        assert found["coverage"] == 1.0 and found["start"] == start
        assert texts[key[0]][1][found["start"] : found["end"]].strip("./") == wording.upper().strip("./")
        assert found["first_word"] == 30


def test_edits_and_repeats(spark):
    words = TEMPLATES["ISC"][0].split()
    edited = words[:8] + ["really"] + words[8:15] + words[16:]
    text = " ".join(edited) + " " + sentence(1, 50) + " " + " ".join(words)
    found = [r for r in scan(spark, [(1, text)]) if r["license"] == "ISC"]
    assert len(found) == 2
    assert found[0]["coverage"] == (len(words) - 1 + 1) / (len(words) + 1) or 0.9 < found[0]["coverage"] < 1
    assert found[1]["coverage"] == 1.0
    cut = " ".join(words[: len(words) // 2])
    assert not [r for r in scan(spark, [(1, cut)]) if r["license"] == "ISC"]


def test_short_notices_in_a_row_are_found_each(spark):
    for name, notice in [(n, t) for n, wordings in TEMPLATES.items() for t in wordings if len(t.split()) < 12]:
        texts, want = [], {}
        for doc, (times, between) in enumerate([(2, ""), (3, ""), (3, "one "), (3, "one two "), (7, "one two three ")]):
            texts.append((doc, ("x " + (notice + " " + between) * times + "y")))
            want[doc] = [2 + i * len(notice + " " + between) for i in range(times)]
        found = [r for r in scan(spark, texts) if r["license"] == name and r["n_words"] < 15]
        assert {d: sorted(r["start"] for r in found if r["doc_id"] == d) for d in want} == want
        assert all(r["coverage"] == 1.0 for r in found)


def test_parts_beside_a_match_are_aligned_again():
    """A notice with a word left out stands between whole ones; the best match is taken first."""
    index = build_index({"X": ["a b c d e f g h"]})
    text = licenses._words(["a b c d f g h a b c d e f g h a b c e f g h z"]).hashes
    row = [(int(at), int(place)) for at in range(len(text)) for place in range(8) if text[at] == index.words[0][place]]
    assert licenses.find(index, text, 0, row, 0.75) == [(0.875, 0, 7), (1.0, 7, 15), (0.875, 15, 22)]


def test_candidates_lose_nothing_that_alignment_alone_finds(spark):
    """All texts of a given table, each template aligned over the whole text without index or band."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    index = build_index(TEMPLATES)
    short = [t for t, w in enumerate(index.words) if len(w) < 15]
    want = set()
    for i, text in rows:
        text_words = licenses._words([text]).hashes
        for t in short:
            template = index.words[t]
            for at in np.flatnonzero(np.isin(text_words, template)):
                part = text_words[max(0, at - 20) : at + 20]
                _, matched, _, _ = align(template, part, 0, 60)
                if matched >= licenses.MIN_COVERAGE * len(template):
                    want.add((i, *index.names[t]))
    got = {(r["doc_id"], r["license"], r["template"]) for r in scan(spark, rows) if r["n_words"] < 25}
    assert want and got == want


def test_alignment_counts_matches_inside_the_band():
    a = np.array([1, 2, 3, 4, 5, 6], np.uint64)
    assert align(a, np.array([9, 1, 2, 3, 4, 5, 6, 9], np.uint64), 1)[1:] == (6, 1, 7)
    assert align(a, np.array([1, 2, 9, 4, 5, 6], np.uint64), 0)[1:] == (5, 0, 6)
    assert align(a, np.array([1, 2, 3, 8, 4, 5, 6], np.uint64), 0)[1:] == (6, 0, 7)
    assert align(a, np.array([7, 7], np.uint64), 0)[1] == 0


def test_odd_rows(odd, nothing):
    assert scan_licenses(odd).count() == 0
    assert scan_licenses(nothing).count() == 0
    twice = odd.limit(2).union(odd.limit(2)).selectExpr("1L AS doc_id", "'x. Released under the MIT License' AS text")
    assert twice.count() == 4 and scan_licenses(twice).count() == 4
