"""Sharding by a hierarchical weighted hash tree (regions, racks, shards)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import hash_unit, numbered, pick, stored, unsigned_crc32

# Shards that racks and regions are laid out for; further ones open regions of their own.
LAID_OUT = 24


@dataclass(frozen=True)
class Leaf:
    """A shard, its place in the tree, and its weight (a share of the rows)."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0


def tree(shards: int, racks: int = 6, regions: int = 2, laid_out: int = LAID_OUT) -> list[Leaf]:
    """The first ``laid_out`` leaves dealt over ``racks`` racks, the racks over ``regions`` regions.

    Every leaf beyond these opens a rack and a region of its own. So ``tree(n + 1)`` with
    the same layout is ``tree(n)`` and one child more of the root, and no weight inside
    the other regions changes.
    """
    dealt = [Leaf(s, s % racks % regions, s % racks) for s in range(min(shards, laid_out))]
    own = [Leaf(s, regions + s - laid_out, racks + s - laid_out) for s in range(laid_out, shards)]
    return dealt + own


def _drawn(key: Column, level: int, path: tuple[int, ...], children: dict[int, float]) -> Column:
    """The child of a node that a weighted draw of this key on this level takes."""
    draws = [
        F.struct(
            (-F.log(hash_unit(key, *map(F.lit, (level, *path, child)))) / F.lit(weight)).alias("draw"),
            F.lit(child).alias("child"),
        )
        for child, weight in sorted(children.items())
    ]
    return (draws[0] if len(draws) == 1 else F.least(*draws))["child"]


def place(key: Column, leaves: Iterable[Leaf]) -> Column:
    """The shard of a key: the tree is descended by a weighted hash draw on every level.

    A node weighs what its leaves weigh together. On each level every child of the node
    reached has a draw of its own, exponential with its weight as rate, made from a hash of
    key, level and the child's place; the least draw wins, an equal one goes to the smaller
    number. A draw changes only with its own node's weight. So where a shard's weight
    changes, rows move on the levels above it between its rack or region and the others
    there, and inside every other rack and region they stay as they were. A leaf in a
    region of its own takes rows into itself alone. Leaves of no weight get no rows.
    """
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[leaf.shard] = float(leaf.weight)
    if not regions:
        raise ValueError("no shard has a weight above 0")

    def branch(drawn: Column, ways: dict[int, Column]) -> Column:
        """The way of the child drawn; only that one is gone."""
        if len(ways) == 1:
            return next(iter(ways.values()))
        cases = None
        for child, way in sorted(ways.items()):
            cases = F.when(drawn == child, way) if cases is None else cases.when(drawn == child, way)
        return cases

    ways = {}
    for region, inside in regions.items():
        shards = {rack: _drawn(key, 2, (region, rack), below) for rack, below in inside.items()}
        weights = {rack: sum(below.values()) for rack, below in inside.items()}
        ways[region] = branch(_drawn(key, 1, (region,), weights), shards)
    weights = {region: sum(sum(below.values()) for below in inside.values()) for region, inside in regions.items()}
    return branch(_drawn(key, 0, (), weights), ways).cast("int")


def shard_documents(
    docs: DataFrame, shards: int = 24, racks: int = 6, regions: int = 2, laid_out: int = LAID_OUT
) -> DataFrame:
    """Puts every row into a shard by its ``doc_id`` (law ``key``).

    Needs ``doc_id`` and ``text``; other columns are ignored. Returns doc_id, size
    (UTF-8 bytes of the text plus 8; a null text has none), text_crc32, law, shard,
    slot (gapless within the shard) and grown_shard, the shard with one more leaf. Fewer shards
    than ``laid_out`` are themselves the layout, which is then to be given as they grow.
    Nulls: a null ``doc_id`` is hashed as a null and placed like any other key.
    Empty and very long texts differ only in size and checksum. Repeated rows share
    a shard and get different slots; which of equal rows gets which is arbitrary.
    An empty table gives no rows. Equal texts are not kept together, as only the
    key decides; ``text_crc32`` tells them.
    """
    text = F.col("text")
    layout = min(shards, laid_out)
    small, large = (tree(n, racks, regions, layout) for n in (shards, shards + 1))
    placed = pick(docs, doc_id="long", text="string").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        unsigned_crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col("doc_id"), small).alias("shard"),
        place(F.col("doc_id"), large).alias("grown_shard"),
    )
    order = ["doc_id", "size", "text_crc32"]
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return numbered(stored(placed, "sharded"), ["shard"], order, "slot").select(*columns)
