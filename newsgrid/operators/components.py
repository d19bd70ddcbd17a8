"""Connected components of an edge table by alternating star steps.

Each round points every node's larger neighbours at its smallest neighbour (large star), then every node's smaller
neighbours and itself at the smallest of them (small star).  Only minima per node are aggregated, so a node with very
many neighbours is pre-aggregated like any other; the number of rounds grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgrid.checkpoint import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    near = edges.join(low, "b")
    moved = near.filter(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(low.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge table; component is the smallest node that can be reached.

    Edges may be repeated and point either way; loops keep their node; edges with a null end are ignored.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    ends = checkpointed(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = ends.filter("a < b")
    state, seen = links, None
    for _ in range(max_rounds):
        state = checkpointed(_small_star(_large_star(state)))
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    alone = ends.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    labels = state.select(F.col("b").alias("node"), F.col("a").alias("component")).union(state.select(F.col("a").alias("node"), F.col("a").alias("component"))).union(alone)
    return labels.groupBy("node").agg(F.min("component").alias("component"))
