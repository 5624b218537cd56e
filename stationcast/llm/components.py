"""Connected components by alternating large-star and small-star steps over an edge table.

Each step is two shuffles: the smallest neighbour per node (combined on the map side) and a join that
hands it to the node's edges, which the optimizer can split where one node has very many edges. The edge
table of each round is written to the shared folder, so nothing grows a lineage and lost executors cost one
round at most. Only a count and a checksum per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    larger = both.where("b > a")
    # Repeated edges are left to the small star, whose result is distinct: an edge makes one edge at most.
    return larger.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the smallest of them. ``a > b`` throughout."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b")
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    ``edges`` has columns a and b (long). Null ends and loops are left out, repeated edges count once. Without
    edges the result is empty. Nodes without an edge are not in the result.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stored(spark, now, "edges"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if tuple(seen) == before or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select("b", F.col("b").alias("component")).distinct().withColumnRenamed("b", "node")
            )
        before = tuple(seen)
        now = stored(spark, _small_star(_large_star(now)), "edges")
