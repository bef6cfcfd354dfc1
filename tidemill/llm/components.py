"""Connected components of an edge table by alternating star contraction.

Each round is two aggregates and two joins on the edge table; nothing is gathered. The edges are written
to the shared folder after each round. A hub with a third of all edges is a key of an aggregate
(combined before the shuffle) and of an inner join whose large side adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node hands its (larger or smaller) neighbours to its least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.filter("b < a")
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = (both.filter("b > a") if large else seen).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _tangled(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller and a larger one: the edges are then no finished stars yet."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    return ends.groupBy("n").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).filter("low > 1 or (low = 1 and high > 0)").limit(1).count() > 0


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node that has an edge; ``edges`` has columns a and b.

    Self-links and repeated links change nothing; links with a null end are left out; no links give no rows.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while _tangled(edges):
        edges = materialise(_star(_star(edges, True), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
