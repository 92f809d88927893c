"""Greedy grouping of a match graph.

In ascending order, each vertex that is still open becomes a seed and absorbs its open
neighbours. What happens in one connected component doesn't depend on the others, so
components that one task can hold are decided in one pass over their sorted edges. Only
what is larger is decided in rounds over the whole cluster.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.sinks.snapshots import cut

#: Edges of one component that a task decides: some 100 MB of vertex names.
ROOM = 1_000_000


def _in_one_pass(edges: DataFrame, dealt: bool) -> DataFrame:
    """(v, seed) of components that a task can hold; ``edges`` have a ``component`` if they are ``dealt`` by it.

    The pass is nested so that it travels with the task. Vertices only have to be told apart
    there, so they come as text beside their own type.
    """

    def absorbing(batches):
        component, absorbed = None, set()
        for batch in batches:
            taken = []
            for c, lo, hi in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                if c != component:
                    component, absorbed = c, set()
                taken.append(lo not in absorbed and hi not in absorbed)
                if taken[-1]:
                    absorbed.add(hi)
            yield batch.select([0, 1]).filter(pa.array(taken, pa.bool_()))

    name = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    component = F.to_json(F.struct("component")) if dealt else F.lit("")
    rows = edges.select(F.col("hi").alias("v"), F.col("lo").alias("seed"), component.alias("_c"), name("lo").alias("_lo"), name("hi").alias("_hi"))
    rows = rows.repartition("_c") if dealt else rows.repartition(1)
    schema = rows.select("v", "seed").schema
    return rows.sortWithinPartitions("_c", "seed", "v").mapInArrow(absorbing, schema)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, component): the least vertex that each other vertex of an edge (lo, hi) is connected with.

    Alternating stars: every vertex hands its larger neighbours on to its least one, then its smaller
    ones. The rounds grow with the logarithm of the longest path; each is written down.
    """

    def with_least(links: DataFrame) -> DataFrame:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        return links.join(least, "u").withColumn("m", F.least("u", "m"))

    stars, before = cut(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")), "links"), None
    while (now := _state(stars)) != before:
        before = now
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        small = with_least(large)
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        stars = cut(linked.filter("u > v").distinct(), "stars")
    return stars.select("u", F.col("v").alias("component"))


def _absorbed_now(edges: DataFrame) -> DataFrame:
    """Vertices next to a vertex that has no smaller neighbour left."""
    waiting = edges.select(F.col("hi").alias("lo")).distinct()
    return edges.join(waiting, "lo", "left_anti").select(F.col("hi").alias("v")).distinct()


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.withColumnRenamed("v", "lo"), "lo", "left_anti").join(
        gone.withColumnRenamed("v", "hi"), "hi", "left_anti"
    )


def _in_rounds(edges: DataFrame) -> DataFrame:
    """(v, seed) of edges of any number.

    Each round decides all vertices without a smaller open neighbour at once; what remains is
    written down, so plans stay short and a lost executor costs no earlier round.
    """
    rounds, left = [], edges
    while not left.isEmpty():
        rounds.append(cut(_absorbed_now(left), "absorbed"))
        left = cut(_without(left, rounds[-1]).select("lo", "hi"), "open_edges")
    absorbed = reduce(DataFrame.union, rounds, left.select(F.col("hi").alias("v")))
    from_seeds = edges.join(absorbed.withColumnRenamed("v", "lo"), "lo", "left_anti")
    return from_seeds.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("seed"))


def greedy_groups(edges: DataFrame, room: int = ROOM) -> DataFrame:
    """(v, seed) for every absorbed vertex: its smallest neighbouring seed.

    ``edges`` holds distinct (lo, hi) with ``lo < hi`` and should be a written table, as it is
    read several times. A seed is any vertex that is not absorbed. Up to ``room`` edges are
    decided in one pass of one task; of more, the components of up to ``room`` edges in one
    pass of many tasks.
    """
    if edges.count() <= room:
        return _in_one_pass(edges, dealt=False)
    of = components(edges)
    labelled = cut(edges.join(of.withColumnRenamed("u", "hi"), "hi"), "labelled_edges")
    large = labelled.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > room).select("component")
    large = cut(large, "large_components")
    small = _in_one_pass(labelled.join(large, "component", "left_anti"), dealt=True)
    if large.isEmpty():
        return small
    return small.unionByName(_in_rounds(cut(labelled.join(large, "component").select("lo", "hi"), "large_edges")))
