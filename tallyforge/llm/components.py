"""Connected components of a link table, and packing of groups into tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import checkpointed


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) of every node in `links` (a, b); a component is named by one of its nodes.

    Every round leads each node to its smallest neighbour, renames links and drops those inside a node. Names are taken
    in order of a hash, so that a constant share of nodes goes in every round whatever the shape of the links; rounds
    grow with the logarithm of the largest component. All steps are joins and grouped minima with partial results; the
    links are checkpointed every round."""
    order = F.struct(F.xxhash64("b").alias("h"), F.col("b"))
    edges = checkpointed(links.select("a", "b").filter("a <> b").distinct())
    names = checkpointed(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("name", F.col("node")))
    for _ in range(max_rounds):
        if edges.isEmpty():
            return names.select("node", F.col("name").alias("component"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order).alias("least"))
        smaller = F.col("least.h") < F.xxhash64("a")
        same = (F.col("least.h") == F.xxhash64("a")) & (F.col("least.b") < F.col("a"))
        moves = checkpointed(least.filter(smaller | same).select(F.col("a").alias("old"), F.col("least.b").alias("new")))
        names = checkpointed(
            names.join(moves, F.col("name") == F.col("old"), "left").select("node", F.coalesce("new", "name").alias("name"))
        )
        renamed = (
            edges.join(moves, F.col("a") == F.col("old"), "left")
            .select(F.coalesce("new", "a").alias("a"), "b")
            .join(moves, F.col("b") == F.col("old"), "left")
            .select("a", F.coalesce("new", "b").alias("b"))
        )
        edges = checkpointed(
            renamed.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
    raise RuntimeError(f"not connected after {max_rounds} rounds")
