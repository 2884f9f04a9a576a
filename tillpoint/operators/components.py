"""Connected components of an edge table by alternating star steps; every
round is written, nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.session import materialize


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("low"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root and no root hangs on another."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not ends.filter("up > 1 or (up > 0 and down > 0)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any orderable type -> one row (id, root) per node of an
    edge between different nodes; root is the smallest node of its component."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.distinct(), "edges")
    while not _settled(edges):
        # Larger neighbours of a node move to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(_lowest(both).select("a", F.least("a", "low").alias("low")), "low")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialize(large.distinct(), "large")
        # A node and its smaller neighbours move to the smallest of them.
        low = materialize(_lowest(large), "low")
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = materialize(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
