"""Connected components of a link table, as Spark jobs on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import forget, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a long, b long); component is the least node reachable.

    Alternates two steps until only stars are left: every node tells its larger
    neighbours of the least one (large star), then its smaller neighbours and itself
    (small star). Links only ever get replaced by links to smaller nodes, so a hub
    never gathers pairs; both steps are a minimum by key and a join. Nothing but whether
    it is done comes to the driver. Nulls and loops are left out. No links, no rows.
    """
    start = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = stored(start.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        forget(last)
        # Stars are what is wanted: each node has one link, to a node that has none upwards.
        parents = edges.groupBy(F.col("a").alias("p")).agg(F.count(F.lit(1)).alias("n"))
        chained = edges.join(parents, edges["b"] == parents["p"], "left_semi").select(F.lit(1).alias("x"))
        if chained.unionByName(parents.where("n > 1").select(F.lit(1).alias("x"))).isEmpty():
            break
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
