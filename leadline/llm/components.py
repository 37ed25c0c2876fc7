"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leadline.session import stage


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges (a, b).

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, so a chain of n nodes takes about log(n) rounds. Rounds are written to the shared
    folder: lineage stays short and nothing depends on one executor. No edge: an empty table.
    """
    both = stage(
        edges.select(F.col("a").alias("node"), F.col("b").alias("next"))
        .union(edges.select(F.col("b"), F.col("a")))
        .where(F.col("node") != F.col("next"))
        .distinct()
    )
    first = both.groupBy("node").agg(F.min("next").alias("low"))
    labels = stage(first.select("node", F.least("node", "low").alias("label"), F.lit(True).alias("moved")))
    while True:
        # A node takes the lowest label of its neighbours and of the node that is its label now.
        told = labels.select(F.col("node").alias("next"), "label")
        near = both.join(told, "next").select("node", "label")
        jump = labels.select("node", F.col("label").alias("next")).join(told, "next").select("node", "label")
        lowest = near.union(jump).groupBy("node").agg(F.min("label").alias("low"))
        after = labels.join(lowest, "node").select(
            "node", F.least("label", "low").alias("label"), (F.col("low") < F.col("label")).alias("moved")
        )
        # Counted while the round is written, so that the end takes no job of its own.
        seen = Observation()
        labels = stage(after.observe(seen, F.count(F.when(F.col("moved"), 1)).alias("moved")))
        if not seen.get.get("moved"):
            return labels.select("node", F.col("label").alias("component"))


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, component) after more edges (a, b), by the components of what the labels leave apart.

    Only edges between different components are worked on, with components as their nodes.
    """

    def end(name: str) -> DataFrame:
        return labels.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}"))

    between = (
        edges.join(end("a"), "a", "left")
        .join(end("b"), "b", "left")
        .select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )
    seen = Observation()
    between = stage(between.observe(seen, F.count(F.lit(1)).alias("n")))
    if not seen.get.get("n"):
        return labels
    wider = components(between)
    root, name = F.col("root"), F.col("wider")
    moved = labels.join(wider.select(F.col("node").alias("root"), F.col("component").alias("wider")), F.col("component") == root, "left")
    alone = wider.join(labels.select("node"), "node", "left_anti")  # nodes that had no edge before
    return stage(moved.select("node", F.coalesce(name, "component").alias("component")).union(alone))
