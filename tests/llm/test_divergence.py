import re
from collections import Counter, defaultdict

import pytest

from brute import LOWER
from samples import odd_rows, sentence
from logsluice.llm import divergence
from logsluice.llm.divergence import source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least=3, top=200):
    """The audit by dictionaries, for rows of (text, lang, source)."""
    held, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", la or "", s or "") for t, la, s in rows):
        groups.add((lang, source))
        terms = TERM.findall(text.translate(LOWER))
        held[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for la, s in groups if la == lang)

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p, q = shares(held[lang, source]), shares(sum((held[lang, s] for s in sources), Counter()))
        pairs = []
        for other in sources:
            if other != source:
                o = shares(held[lang, other])
                pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other))
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t) for t in kept if held[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1):
                if part == "pair" or rank <= top:
                    out.append((lang, source, part, item, -value, rank))
    return sorted(out)


def check(docs, rows, **more):
    found = source_divergence(docs, **more)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, **more)


@pytest.fixture
def tight(monkeypatch):
    """Small blocks, pieces, slices and tiles, so that every cut is made."""
    for name, value in (("BLOCK_BYTES", 700), ("PIECE_BYTES", 50), ("ROWS_A_SALT", 40), ("TILE", 2), ("CELLS", 30), ("WORDS", 1)):
        monkeypatch.setattr(divergence, name, value)


def made_rows():
    rows = [(sentence(i % 23, 30 + i), ("en", "de", None)[i % 3], f"s{i * i % 7}") for i in range(90)]
    rows += [("Straße GROSS\U0001f600x été-été 中文中文中文 " * 3, "de", None), ("x" * 400 + " y", "en", "s0")] * 4
    return rows + [("", "en", "empty"), (None, "xx", "a"), ("only once", "xx", "b"), ("1 2 3", "yy", "alone")]


def test_small_cuts(spark, tight):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    check(docs, rows)


def test_given_texts(small):
    check(small, [(r["text"], r["lang"], r["source"]) for r in small.collect()])


def test_odd_rows(spark, odd, nothing):
    rows = odd_rows() * 2
    check(odd.unionByName(odd), [(r[1], r[2], r[3]) for r in rows])
    check(odd, [(r[1], r[2], r[3]) for r in odd_rows()], least=1, top=5)
    assert source_divergence(nothing).count() == 0


def test_prefixes_shared_by_many_rare_terms_go(spark):
    """A prefix in many documents whose terms are each in too few."""
    rows = [(f"common{chr(97 + i)}tail common rest", "en", "a" if i % 2 else "b") for i in range(20)]
    check(spark.createDataFrame(rows, "text string, lang string, source string"), rows)
