"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked with its least neighbour (itself included)."""
    both = edges.union(edges.select("b", "a"))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    out = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "stars")
    release(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself are linked with the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return materialize(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "stars")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges (a, b)``: its component's least node.

    Only tables of links move. Where a node may be hot (the least of a large
    component has all others as its neighbours) the sums are written before they
    are joined, so that Spark can split its links; a step's tables go when the
    next one stands. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = materialize(edges.select("a", "b").where("a != b").distinct(), "links")
    state = None
    while True:
        large = _large_star(edges)
        small = _small_star(large)
        release(edges, large)
        edges = small
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    # after the last step every edge leads from a node to its component's least
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
