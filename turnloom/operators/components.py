"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.session import cut, unsent


def components(edges: DataFrame) -> DataFrame:
    """`edges(a, b)` -> `(node, root)` for every node that has an edge; root is the smallest node reachable.

    Each round hangs all neighbours of a node on the smallest one, first the larger
    neighbours, then the smaller ones, and ends when nothing changes. The number of
    rounds grows with the logarithm of the longest chain, and the edges never
    become more than they were.
    """
    state = cut(_downward(edges.select("a", "b")))
    before = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _downward(both.filter("b > a").join(unsent(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(unsent(lowest), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        state = cut(_downward(small.select("e.a", "e.b")))
    linked = state.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return linked.union(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller one."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
