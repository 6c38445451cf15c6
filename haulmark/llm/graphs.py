"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import keep

JUMPS = 3


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of an edge.

    ``edges`` has ``a`` and ``b``. Each round hooks every node onto its smallest neighbour,
    follows the hooks for a few steps, and goes on with the edges that still join different
    labels. No step gathers a component: they only join and aggregate with partial sums.
    """
    left = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), name)
    labels = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node"))
    while not left.isEmpty():
        hooks = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        for _ in range(JUMPS):
            on = hooks.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            hooks = hooks.join(on, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"))
        hooks = keep(hooks, name)
        moved = hooks.select(F.col("node").alias("component"), "to")
        labels = keep(
            labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), name
        )
        a = hooks.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        b = hooks.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        left = keep(
            left.join(a, "a", "left")
            .join(b, "b", "left")
            .select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .filter("a < b")
            .distinct(),
            name,
        )
    return labels
