import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from logsluice.llm.sharding import Leaf, place, shard_documents, tree


def draw(key, level, path, weight):
    seed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    for value in (level, *path):
        seed = xxhash.xxh64_intdigest(struct.pack("<i", value), seed)
    return -math.log(((seed >> 11) + 0.5) / 2**53) / weight


def plain(key, leaves):
    """Down the tree, level by level, by a draw of each node with its summed weight."""
    path = ()
    for level, name in enumerate(("region", "rack", "shard")):
        weights = Counter()
        for x in leaves:
            weights[getattr(x, name)] += x.weight
        best = min(weights, key=lambda n: draw(key, level, (*path, n), weights[n]))
        leaves = [x for x in leaves if getattr(x, name) == best]
        path = (*path, best)
    return leaves[0].shard


def test_equals_plain_descent_and_grows_into_the_new_shard(small):
    rows = shard_documents(small, 24).collect()
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 8, zlib.crc32(text), "key")
        assert r["shard"] == plain(r["doc_id"], tree(24))
        assert r["grown_shard"] == plain(r["doc_id"], tree(25))
        assert r["grown_shard"] in (r["shard"], 24)
    for shard, n in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def moves(spark, before, after, n=40_000):
    key = F.col("id")
    both = spark.range(n).select(place(key, before).alias("a"), place(key, after).alias("b"))
    return Counter({(r["a"], r["b"]): r["count"] for r in both.groupBy("a", "b").count().collect()})


def test_weights_shares_and_movement(spark):
    leaves = [Leaf(0, 0, 0, 1.0), Leaf(1, 0, 1, 3.0), Leaf(2, 1, 2, 4.0), Leaf(3, 1, 2, 0.0)]
    heavier = [*leaves[:2], Leaf(2, 1, 2, 8.0), leaves[3]]
    pairs = moves(spark, leaves, heavier)
    shares = Counter()
    for (a, b), n in pairs.items():
        shares[a] += n / 40_000
        assert a == b or b == 2  # only towards the heavier region
    assert abs(shares[0] - 1 / 8) < 0.01 and abs(shares[1] - 3 / 8) < 0.01 and shares[3] == 0


def test_a_heavier_rack_moves_rows_through_its_region_alone(spark):
    """The region draws the rows, its racks draw again, the other region stays as it was inside."""
    before = tree(24)
    after = [Leaf(x.shard, x.region, x.rack, 3.0 if x.rack == 2 else 1.0) for x in before]
    at = {x.shard: x for x in before}
    pairs = moves(spark, before, after)
    moved = {k: n for k, n in pairs.items() if k[0] != k[1]}
    region = at[next(s for s in at if at[s].rack == 2)].region
    assert moved
    for a, b in moved:
        if at[a].region != region:
            assert at[b].region == region  # rows of other regions only come in
        else:
            assert at[b].rack == 2  # inside, only towards the heavier rack
    inside = Counter()
    for (_, b), n in pairs.items():
        inside[at[b].rack] += n / 40_000
    assert abs(inside[2] - 3 / 8) < 0.01 and abs(inside[0] - 1 / 8) < 0.01


@pytest.mark.parametrize("shards", [1, 5, 24, 26])
def test_every_further_shard_takes_rows_into_itself_alone(spark, shards):
    layout = min(shards, 24)
    for n in range(shards, shards + 3):
        pairs = moves(spark, tree(n, laid_out=layout), tree(n + 1, laid_out=layout), 20_000)
        assert all(b in (a, n) for a, b in pairs)
        share = sum(count for (_, b), count in pairs.items() if b == n) / 20_000
        assert abs(share - 1 / (n + 1)) < 0.02


def test_grown_shard_is_the_shard_of_the_grown_table(small):
    grown = {r["doc_id"]: r["grown_shard"] for r in shard_documents(small, 24).collect()}
    assert grown == {r["doc_id"]: r["shard"] for r in shard_documents(small, 25).collect()}


def test_odd_rows(odd, nothing):
    rows = shard_documents(odd).collect()
    assert len(rows) == 13
    sizes = {r["doc_id"]: r["size"] for r in rows}
    assert sizes[3] == 8 and sizes[4] == 8 and sizes[6] == len("été à la maison du roi et de la reine".encode()) + 8
    twice = [r for r in rows if r["doc_id"] == 2]
    assert twice[0]["shard"] == twice[1]["shard"] and twice[0]["slot"] != twice[1]["slot"]
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert shard_documents(nothing).count() == 0
