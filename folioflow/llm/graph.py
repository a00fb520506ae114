"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, written


def _star(pairs: DataFrame) -> DataFrame:
    """Pairs (n, m) with the smallest m of each n as ``c``; both sides of the join are shuffled anew, so a hub can be split."""
    return pairs.join(pairs.groupBy("n").agg(F.min("m").alias("c")), "n")


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every node in ``edges`` (long columns ``u, v``): the smallest id reachable.

    The number of rounds grows with the logarithm of the nodes; each round's edges are written to the shared
    folder, no row count grows, and only whether the stars are finished reaches the driver.
    """
    state = written(edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "edges")
    while True:
        both = state.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(state.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        large = _star(both).where("m > n").select(F.col("m").alias("n"), F.least("c", "n").alias("m")).distinct()
        small = _star(written(large, "edges"))
        links = small.where("m <> c").select(F.col("m").alias("hi"), F.col("c").alias("lo")).unionByName(small.select(F.col("n").alias("hi"), F.col("c").alias("lo")))
        after = written(links.distinct(), "edges")
        discard(state)
        state = after
        centres = state.select(F.col("lo").alias("hi")).distinct()
        if state.join(centres, "hi", "left_semi").isEmpty():
            break
    return state.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(state.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
