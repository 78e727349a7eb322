"""Exact dedup by an extendible-hash index on shared files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import WHITE_SPACE, forget, pick, shuffle_tasks, stored

MAX_DEPTH = 14


def directory(filled: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[int]:
    """The bucket of each of the 2 ** max_depth key prefixes.

    ``filled`` counts the distinct keys by prefix. One bucket holds all keys at
    first. An overfull one splits by its next key bit; if it already uses all bits
    of the directory, the directory doubles first. Several directory places name
    one bucket as long as that has not split so far. A bucket of a single prefix
    cannot split further and may stay overfull.
    """
    counts = [[filled.get(p, 0) for p in range(1 << max_depth)]]
    while len(counts[-1]) > 1:  # sums for ever shorter prefixes
        below = counts[-1]
        counts.append([below[i] + below[i + 1] for i in range(0, len(below), 2)])
    depth, places, local, waiting = 0, [0], [(0, 0)], [0]
    while waiting:
        bucket = waiting.pop()
        prefix, used = local[bucket]
        if used == max_depth or counts[max_depth - used][prefix] <= capacity:
            continue
        if used == depth:
            places, depth = [b for b in places for _ in (0, 1)], depth + 1
        other = len(local)
        local[bucket], right = (prefix * 2, used + 1), (prefix * 2 + 1, used + 1)
        local.append(right)
        shift = depth - used - 1
        places[right[0] << shift : (right[0] + 1) << shift] = [other] * (1 << shift)
        waiting += [bucket, other]
    return [places[p >> (max_depth - depth)] for p in range(1 << max_depth)]


CHAIN = "bucket int, key long, sha string, norm binary, n long, chars long, doc_id long"


class Chain:
    """Texts under one key: one link for each different text, found by comparing bytes."""

    def __init__(self) -> None:
        self.links: list[list] = []

    def add(self, row: list) -> None:
        for link in self.links:
            if link[3] == row[3]:
                link[4] += row[4]
                if _rank(row) < _rank(link):
                    link[5:] = row[5:]
                return
        self.links.append(row)


def _rank(link: list) -> tuple:
    return -link[5], link[6] is None, link[6] or 0


def _arrow(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


FULL = pa.schema(
    [
        ("bucket", pa.int32()),
        ("key", pa.int64()),
        ("sha", pa.string()),
        ("norm", pa.binary()),
        ("n", pa.int64()),
        ("chars", pa.int64()),
        ("doc_id", pa.int64()),
    ]
)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins equal texts of a batch, so that a large group moves as few rows."""
    for batch in batches:
        chains: dict[int, Chain] = {}
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            chains.setdefault(row[1], Chain()).add(list(row))
        yield _arrow([link for chain in chains.values() for link in chain.links], FULL)


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner task walks its buckets in key order and closes each key's chain."""
    key, chain, done = None, Chain(), []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[1] != key:
                done += chain.links
                key, chain = row[1], Chain()
            chain.add(list(row))
        if len(done) > 1000:
            yield _groups(done)
            done = []
    done += chain.links
    yield _groups(done)


GROUPS = pa.schema(
    [
        ("bucket", pa.int32()),
        ("key", pa.int64()),
        ("sha", pa.string()),
        ("group_size", pa.int64()),
        ("keep_id", pa.int64()),
    ]
)


def _groups(links: list[list]) -> pa.RecordBatch:
    return _arrow([[x[0], x[1], x[2], x[4], x[6]] for x in links], GROUPS)


def exact_duplicates(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """Groups of texts that are identical without their white space.

    Needs ``doc_id`` and ``text``; other columns are ignored. Returns one row per
    row: doc_id, keep_id, group_size, kept, text_sha256, and the index bucket.
    The row with the most code points in its original text stays, then the one
    with the smallest doc_id.

    1. Each row becomes an entry (id, 64-bit key, code points, digest), written to
       the shared folder.
    2. The distinct keys are counted by their first 14 bits. From these at most 16,384
       counts the driver makes the directory: buckets over ``capacity`` split, the
       directory doubling when needed. More keys than the directory can split only
       make larger buckets.
    3. Rows go to the owner of their bucket with their text, equal ones of a batch
       joined first, so that a group with a third of all rows moves one row per batch.
       An owner reads its range of keys in order; texts under one key are compared
       byte by byte and chained when they differ.
    4. Entries find their group by key and digest.

    Null and empty texts, and texts of white space only, are equal to each other.
    A null doc_id loses to any other. Rows with the same doc_id and text count one
    by one and carry the same flag. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.translate(text, WHITE_SPACE, "")
    base = pick(docs, doc_id="long", text="string").select(
        "doc_id", norm.alias("norm"), F.length(text).cast("long").alias("chars")
    )
    entry = [F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha")]
    entries = stored(base.select("doc_id", "chars", *entry), "entries")

    prefix = F.shiftrightunsigned(F.col("key"), 64 - MAX_DEPTH).cast("int")
    keys = entries.select("key").distinct()
    filled = {r[0]: r[1] for r in keys.groupBy(prefix.alias("p")).count().collect()}  # at most 2 ** MAX_DEPTH
    buckets = directory(filled, capacity)
    places = spark.createDataFrame(list(enumerate(buckets)), "place int, bucket int")

    index = (
        base.select("doc_id", "chars", "norm", *entry)
        .join(F.broadcast(places), prefix == F.col("place"))  # 2 ** MAX_DEPTH rows of two numbers
        .select(
            "bucket", "key", "sha", F.col("norm").cast("binary"), F.lit(1).cast("long").alias("n"), "chars", "doc_id"
        )
        .mapInArrow(_combined, CHAIN)
        .repartition(shuffle_tasks(spark), "bucket")
        .sortWithinPartitions("bucket", "key")
        .mapInArrow(_owned, "bucket int, key long, sha string, group_size long, keep_id long")
    )
    groups = stored(index, "hash-index")
    return entries.join(groups, ["key", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
    )


def drop_exact_duplicates(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are.

    Rows that share doc_id and text leave one row, too. A null doc_id stays only
    where its whole group has null ids.
    """
    index = exact_duplicates(docs, capacity)
    decided = stored(index, "exact-groups")
    forget(index)
    kept = decided.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    kept = stored(kept.withColumnsRenamed({"doc_id": "id", "text_sha256": "sha"}), "exact-kept")
    forget(decided)
    norm = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), WHITE_SPACE, "")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(norm, 256).alias("digest")
    )
    found = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha")))
    once = found.where("times = 1").select("row.*")
    if kept.where("times > 1").isEmpty():
        return once
    again = found.where("times > 1").dropDuplicates(["doc_id", "digest"]).select("row.*")
    return once.unionByName(again)
