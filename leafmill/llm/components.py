"""Distributed connected components by alternating large and small stars.

Each round's edges and least neighbours are stored in the shared folder; no component, node list or edge list ever
reaches the driver or one task: a node's least neighbour is an aggregate, and as both sides of its join with the edges
come straight from a shuffle, Spark splits the edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.put(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): component is the least node reachable; nodes without an edge are not listed.

    edges has long columns u and v; loops, nulls and repeated edges do no harm.
    """
    now = scratch.put(edges.where("u != v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        digest = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
        if digest == before or not digest[0]:
            break
        before = digest
        large = scratch.put(_large_star(now, scratch), "edges")
        new = scratch.put(_small_star(large, scratch), "edges")
        scratch.drop(*[df for df, path in list(scratch.paths.values()) if path.endswith("-least")], now, large)
        now = new
    # stars now: every node but the least points to it
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
