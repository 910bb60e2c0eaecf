"""Connected components by alternating large and small stars, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); component is the least node that is reachable.

    Every round aggregates each node's least neighbour before it shuffles, so a node with very many
    edges costs one row per task. Edges with a null end and loops are ignored; no edges give no rows.
    Rounds grow with the logarithm of the longest path.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct())
    seen = _digest(e)
    if seen[0] == 0:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    for _ in range(MAX_ROUNDS):
        both = e.select(F.col("hi").alias("a"), F.col("lo").alias("b")).union(e.select("lo", "hi"))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = cut(small.union(least.select("hi", "m")).distinct())
        now = _digest(e)
        if now == seen:
            roots = e.select(F.col("lo").alias("node")).distinct()
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        seen = now
    raise RuntimeError(f"components: no fixed point after {MAX_ROUNDS} rounds")


def _digest(e: DataFrame) -> tuple:
    """Count and order-free checksum of an edge list."""
    r = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return r[0], r[1]
