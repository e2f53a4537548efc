"""Connected components of an edge table, by stars.

Each round links every vertex's larger neighbours to its smallest one, then its smaller
neighbours to the smallest of them. Both keep components as they are; in the end every
vertex is linked to its component's smallest, after a number of rounds that grows with
the logarithm of the table. Smallest neighbours are found by aggregates that combine in
each task, and hubs are on the side of a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlabel.llm.common import materialize


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex that ``edges`` (a, b) link to a smaller one.

    Edges may repeat, point either way or be loops; vertices that are their component's
    smallest have no row.
    """
    current = edges.where("a <> b").select("a", "b")
    while True:
        large = _stars(_both_ways(current), larger_only=True)
        current = materialize(_stars(_both_ways(large), larger_only=False), "edges")
        if _are_stars(current):
            return current.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex is a root, or has one edge, to a root."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    counts = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return counts.where("up > 1 OR up = 1 AND root = 1").isEmpty()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Links the larger (or the smaller) neighbours b of each a to the smallest of a and
    its neighbours; in the second case a itself as well."""
    least = pairs.groupBy(F.col("a").alias("hub")).agg(F.least("hub", F.min("b")).alias("low"))
    joined = pairs.join(least, pairs["a"] == least["hub"])
    linked = joined.where("b > hub" if larger_only else "b < hub").select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not larger_only:
        linked = linked.unionByName(least.select(F.col("hub").alias("a"), F.col("low").alias("b"))).distinct()
    return linked.where("a <> b")
