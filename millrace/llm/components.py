"""Connected components by rounds of hooking and contraction, as joins on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); a component is named by its smallest node.

    In each round every label hooks onto its smallest neighbour, nodes and edges take over
    the new labels, and edges inside one label go. A star is done after one round; the number
    of labels at least halves, so rounds grow with the logarithm of the longest path.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        hook = stored(both.groupBy(F.col("a").alias("label")).agg(F.least(F.first("a"), F.min("b")).alias("onto")))
        labels = stored(
            labels.join(hook, F.col("component") == F.col("label"), "left").select("node", F.coalesce("onto", "component").alias("component"))
        )
        low, high = hook.toDF("a", "a2"), hook.toDF("b", "b2")
        moved = edges.join(low, "a").join(high, "b").where("a2 <> b2")
        edges = stored(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    return labels
