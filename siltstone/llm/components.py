"""Connected components of a graph of links, by alternating large-star and small-star steps.

Links stay in tables of the shared folder; each step is one written table, so that no lineage grows
and a lost executor costs one step at most. Every node ends with its component's smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Links of every node's kept neighbours to the smallest of node and neighbours; the smallest are pre-aggregated."""
    low = pairs.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
    linked = pairs.join(low, "a").where(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(low.select("a", F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) of any orderable type -> (node, root): every node of an edge with its component's smallest node."""
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not e.isEmpty():
        large = _star(_neighbours(e), F.col("b") > F.col("a"))
        e = materialise(_star(large, F.lit(True)).distinct(), name)
        # done when each node has one link and no link leads to a node that has one itself
        left = e.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if e.join(left.where("n > 1").select("a"), "a", "left_semi").isEmpty() and e.select(F.col("b").alias("a")).join(e.select("a"), "a", "left_semi").isEmpty():
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b"))).distinct()
