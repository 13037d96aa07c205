"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import stage, tidied


def _between(links: DataFrame, a: Column, b: Column) -> DataFrame:
    """Each link once, smaller end first, loops dropped."""
    return links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b, longs): root is the component's smallest node.

    In each round every node hooks onto its least neighbour if that is smaller, chains of hooks are followed to their
    ends by doubling, and the graph shrinks to those ends: links within what is joined already go, so a dense group
    is read once and not in every round. Every step ends in a table in the shared folder; only whether rows are left
    reaches the driver. No links: an empty table.
    """
    with tidied() as kept:
        return kept(_joined(stage(_between(links, F.col("a"), F.col("b")), "links")))


def _joined(links: DataFrame) -> DataFrame:
    labels = None
    while True:
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        parents = stage(ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "parents")
        while True:
            above = parents.select(F.col("node").alias("up"), "root")
            jumped = stage(parents.withColumnRenamed("root", "up").join(above, "up").select("node", "root", "up"), "parents")
            parents = jumped.select("node", "root")
            parents.staged_at = jumped.staged_at
            if not jumped.where("root <> up").limit(1).count():
                break
        if labels is None:
            labels = parents
        else:
            above = parents.select(F.col("node").alias("up"), F.col("root").alias("top"))
            labels = labels.withColumnRenamed("root", "up").join(above, "up", "left")
            labels = stage(labels.select("node", F.coalesce("top", "up").alias("root")), "labels")
        x, y = (parents.select(F.col("node").alias(end), F.col("root").alias(new)) for end, new in (("a", "x"), ("b", "y")))
        links = stage(_between(links.join(x, "a").join(y, "b"), F.col("x"), F.col("y")), "links")
        if not links.limit(1).count():
            return labels
