"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.engine import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "term") -> DataFrame:
    """``node, root``: every node with the least node of its component.

    ``edges`` has the columns ``l, r``. Both steps only aggregate and join on nodes; each round is written to the shared
    folder, and the loop ends when a round changes nothing. Nodes without edges are their own root; edges may repeat.
    """
    current = checkpoint(edges.select(F.col("l").alias("u"), F.col("r").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        current = checkpoint(_small_star(_large_star(current)))
        # Edges are distinct: their number and the sum of their hashes tell whether a round changed any.
        after = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("long"))).first()
        if after == before:
            break
        before = after
    return nodes.select(F.col(node)).join(current.select(F.col("u").alias(node), F.col("v").alias("root")), node, "left").select(
        node, F.coalesce("root", node).alias("root")
    )
