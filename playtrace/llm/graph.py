"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.scratch import saved


def _is_done(edges: DataFrame) -> bool:
    """Whether every node above has one edge, to a node that has none."""
    below = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    held = below.union(ends).groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return held.where("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's smallest neighbour."""
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    low = low.select("a", F.least("a", "m").alias("m"))
    above = both.where("b > a").join(low, "a")
    return above.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(v, c)`` for every node of ``edges(a, b)``: the smallest node that it reaches.

    Each round is two joins on nodes and is saved in the shared folder, so lineage stays
    short. The number of rounds grows with the logarithm of the longest path.
    """
    down = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = saved(down.distinct())
    while not _is_done(now):
        now = saved(_small_star(_large_star(now)))
    below = now.select(F.col("a").alias("v"), F.col("b").alias("c"))
    return below.union(now.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
