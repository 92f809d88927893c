"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.snapshots import cut


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and all its v; a node of many edges is split by the join, not by a window."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    small = _with_least(large)
    linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
    return linked.where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``id`` and ``component`` (the least id that is reachable) of every node of an edge that isn't the least itself.

    Every round is written to the shared folder, so a lost executor costs no more than the round. In the end each
    node has one edge, to the least of its component. Rounds grow with the logarithm of the longest path, roughly.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = cut(edges, "links")
    before = _state(edges)
    while before[0]:
        edges = cut(_round(edges), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
