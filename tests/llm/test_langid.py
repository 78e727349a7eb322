import zlib

import numpy as np
import regex

from samples import odd_rows
from logsluice.llm import langid
from logsluice.llm.langid import identify_documents, keep_identified, viterbi


def plain_value(scores, switch):
    best = scores[0].astype(float)
    for s in scores[1:]:
        best = np.maximum(best, best.max() - switch) + s
    return best.max()


def test_blockwise_viterbi_equals_one_pass():
    rng = np.random.default_rng(1)
    for _ in range(20):
        k, counts = int(rng.integers(1, 6)), rng.choice([0, 1, 2, 63, 64, 65, 128, 300], 6)
        rows = np.concatenate(([0], np.cumsum(counts)))
        scores = rng.normal(0, 3, (rows[-1], k)).astype(np.float32)
        labels = viterbi(scores, rows, 4.0)
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            if a < b:
                path = labels[a:b]
                value = scores[np.arange(a, b), path].sum() - 4.0 * (path[1:] != path[:-1]).sum()
                assert abs(value - plain_value(scores[a:b], 4.0)) < 1e-2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = identify_documents(docs).collect()
    assert len(found) == len(lang)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    pick = {}
    for r in docs.where("length(text) > 1500").orderBy("doc_id").collect():
        pick.setdefault(r["lang"], " ".join(r["text"].split()[:120]))
    mixed = pick["fr"] + " " + pick["de"] + " " + pick["en"]
    (r,) = langid.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).collect()
    long = [s for s in r["spans"] if s["words"] > 40]
    assert [s["lang"] for s in long] == ["fr", "de", "en"]
    assert r["spans"][0]["first"] == 0
    for a, b in zip(r["spans"], r["spans"][1:], strict=False):
        assert a["first"] + a["words"] == b["first"] and a["lang"] != b["lang"]


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, f"слово дом вода {i}", "ru") for i in range(20)] + [(i, f"word house water {i}", "en") for i in range(20, 40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(1, "совсем другое"), (2, "something else"), (3, "ελληνικά"), (4, "東京")]
    found = langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in found}
    assert got[1] == "ru" and got[2] == "en"
    assert got[3] in ("ru", "en") and got[4] in ("ru", "en")  # a script no one taught


def test_punctuation_beyond_ascii_is_no_part_of_words(spark):
    rows = [(i, f"hello and wait {i}", "en") for i in range(9)] + [(i, f"слово и дом {i}", "ru") for i in range(9, 18)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["hello and wait", "“hello” —and …wait", "«слово» — дом…", "\u0301hello", "x", "々", "ⁿ", "𠀀", "ﬁ", "ℓ"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(frame, model).collect()}
    assert all(r["lang_pred"] in ("en", "ru") and r["score"] > 0 and r["spans"] for r in got.values())
    assert (got[1]["lang_pred"], got[1]["score"], got[1]["spans"]) == ("en", got[0]["score"], got[0]["spans"])
    assert got[2]["lang_pred"] == "ru" and got[3]["lang_pred"] == "en"
    nothing = [(i, t) for i, t in enumerate(["—", "…“”", "\u0301", "12 ³ ½", "§ ☃ 😀", "١٢"])]
    found = langid.identify(spark.createDataFrame(nothing, "doc_id long, text string"), model).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}


def test_every_text_with_a_letter_gets_a_language(spark):
    """Word by word against a plain version: which words there are, and their best label alone."""
    rng = np.random.default_rng(5)
    signs = list("ab дж é \u0301\u0300 “”—…'.,-1²々ⁿ漢𠀀אب\u200c\u00ad😀")
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 12)))) for _ in range(400)]
    rows = [(i, "aab ba", "en") for i in range(5)] + [(i, "джд ж", "ru") for i in range(5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.identify(frame, model).collect():
        words = regex.findall(r"\p{L}[\p{L}\p{M}]*", texts[r["doc_id"]])
        assert (r["lang_pred"] == "und") == (not words)
        assert sum(s["words"] for s in r["spans"]) == len(words)


def test_odd_rows(odd, nothing):
    found = identify_documents(odd).collect()
    assert len(found) == 13
    got = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for i in (3, 4, 5, 7):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["spans"]) == ("und", 0.0, [])
    assert got[1]["lang_pred"] in ("en", "fr") and got[8]["lang_pred"] in ("en", "fr")
    assert sum(s["words"] for s in got[8]["spans"]) == 60_000
    assert identify_documents(nothing).count() == 0
    untaught = odd.withColumn("lang", odd["lang"].substr(100, 1)).where("lang IS NULL")
    assert {r["lang_pred"] for r in identify_documents(untaught).collect()} <= {"und"}


def test_stage_keeps_columns_and_fills_lang(odd, nothing):
    kept = keep_identified(odd, 0.34)
    assert kept.columns == odd.columns
    rows = kept.collect()
    lettered = [r for r in odd_rows() if r[0] not in (3, 4, 5, 7) and r[1] is not None]
    assert len(rows) == len(lettered)
    assert all(r["lang"] in ("en", "fr") for r in rows)
    assert keep_identified(nothing, 0.34).count() == 0
