"""Connected components of an edge table, without collecting anything.

Large-star and small-star steps in turn (Kiveris et al., 2014): each replaces
edges by edges to smaller neighbours until every component is a star around its
smallest node.  A node's smallest neighbour is found by an aggregate with
map-side combination, stored, and joined back, so that a hub with millions of
edges is a skewed join of two plain tables, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfmill.llm.shared import Workspace


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(space: Workspace, edges: DataFrame, name: str) -> DataFrame:
    near = _both_ways(edges)
    least = space.save(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    return near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(space: Workspace, edges: DataFrame, name: str) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = space.save(down.groupBy("u").agg(F.min("v").alias("m")), name)
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(space: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for each node with an edge; component is the smallest node that can be reached.

    `edges` has long columns a and b; loops and repeats are harmless.
    """
    now = space.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}_0")
    mark, k = None, 0
    while True:
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if seen == mark or not seen[0]:
            break
        mark, k = seen, k + 1
        large = space.save(_large_star(space, now, f"{name}_l{k}"), f"{name}_large{k}")
        now = space.save(_small_star(space, large, f"{name}_s{k}"), f"{name}_{k}")
        space.drop(f"{name}_{k - 1}", f"{name}_large{k}", f"{name}_l{k}", f"{name}_s{k}")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
