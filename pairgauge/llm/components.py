"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation with map-side combine and a join. The smallest neighbour of each node is
written to the shared folder first, so the join starts from two plain inputs and a hub's rows can be
split over tasks. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))
    ).first()
    return tuple(row)


def _least(pairs: DataFrame) -> DataFrame:
    return stored(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node reached.

    Loops and repeated edges do no harm; a node without an edge to another has no row.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = stored(edges.where("a <> b").select(larger, smaller).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.select("a", "b").union(now.select("b", "a"))
        large = both.join(_least(both), F.col("a") == F.col("node"))
        large = large.where("b > a").select(
            F.col("b").alias("a"), F.least("a", "least").alias("b")
        )
        large = stored(large.distinct())
        least = _least(large)
        joined = large.join(least, F.col("a") == F.col("node"))
        small = joined.where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        own = least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        now = stored(small.union(own).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
