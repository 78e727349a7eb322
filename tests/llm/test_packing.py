import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from samples import odd_rows
from logsluice.llm.packing import Packer, Piece, pack_documents, tokenizer

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, size=1024):
    """Round trip: the pieces give back every document; sequences are whole and full."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) >= set(docs)
    for i, text in docs.items():
        ids, at = ids_of(text), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            raw = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(raw)
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    tokens = sum(r["length"] for r in rows)
    return len(by_sequence) * size - tokens, tokens


def test_round_trip(small, texts):
    padding, tokens = check(pack_documents(small).collect(), texts)
    assert padding < 0.02 * tokens


def test_many_partitions_merge_their_leftovers(small, texts):
    docs = small.repartition(37, "doc_id")
    padding, tokens = check(pack_documents(docs).collect(), texts)
    assert padding < 0.02 * tokens


def test_small_windows_and_long_documents(small, texts):
    rows = pack_documents(small, size=64, windows=3, min_piece=4).collect()
    padding, tokens = check(rows, texts, 64)
    assert padding < 0.06 * tokens


def test_odd_rows(odd, nothing):
    rows = pack_documents(odd).collect()
    docs = {r[0]: r[1] for r in odd_rows() if r[0] not in (2, None)}
    check(rows, docs)
    for doc_id in (2, None):
        want = sum(len(ids_of(r[1])) for r in odd_rows() if r[0] == doc_id)
        assert sum(r["length"] for r in rows if r["doc_id"] == doc_id) == want
    assert pack_documents(nothing).count() == 0


@pytest.mark.parametrize("text", ["", "a", "Été 42 !!\n\n  x", "<|endoftext|>", "a<|endoftext|>b", "ab" * 300, "\x00\x85 "])
def test_ranks_give_the_ids_of_the_library(text):
    assert tokenizer()(text).tolist() == ids_of(text)[:-1]


def test_ranks_give_the_ids_of_whole_documents(texts):
    ids = tokenizer()
    for text in texts.values():
        assert ids(text).tolist() == ids_of(text)[:-1]


def piece(n):
    return Piece(1, 0, np.arange(n, dtype="<u4"), n)


def test_best_fit_and_bounded_space():
    p = Packer(10, 2, 2)
    p.add(piece(7))
    p.add(piece(4))
    assert [w.free for w in p.open] == [3, 6]
    p.add(piece(3))  # the tighter window, which is then full
    assert [w.free for w in p.open] == [6] and len(p.done) == 1
    p.add(piece(8))
    p.add(piece(7))  # none fits and both are open: the fullest is filled up and leaves
    assert [w.free for w in p.done] == [0, 0] and [w.free for w in p.open] == [1]
    p.add(piece(25))
    assert len(p.open) <= 2
    total = sum(len(x.ids) for w in p.done + p.close() for x in w.pieces)
    assert total == 7 + 4 + 3 + 8 + 7 + 25
