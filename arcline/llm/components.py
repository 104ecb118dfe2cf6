"""Connected components of a table of links, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcline.llm.common import stage, tidy


@tidy
def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that it is connected with.

    Each round hangs every node under its smallest neighbour, shortens the trees to their roots, and goes on with the links between
    different roots, of which there are fewer every time; it ends when none is left.  Links of a node with itself and null ends say nothing.
    An empty table gives no rows.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    above: list[DataFrame] = []
    while edges.limit(1).count():
        ends = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        roots = _roots(stage(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "above"))
        above.append(roots)
        left, right = (roots.select(F.col("node").alias(k), F.col("up").alias(f"_{k}")) for k in "ab")
        between = edges.join(left, "a").join(right, "b").where("_a <> _b")
        edges = stage(between.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
    if not above:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = above[0]
    for roots in above[1:]:
        then = roots.select(F.col("node").alias("up"), F.col("up").alias("_then"))
        out = out.join(then, "up", "left").select("node", F.coalesce("_then", "up").alias("up"))
    return out.select("node", F.col("up").alias("component"))


def _roots(above: DataFrame) -> DataFrame:
    """``above`` (node, up), where up is at most node, with up the root: each step doubles the way that a node has come."""
    while True:
        then = above.select(F.col("node").alias("up"), F.col("up").alias("_then"))
        above = stage(above.join(then, "up").select("node", F.col("_then").alias("up"), (F.col("_then") < F.col("up")).alias("_moved")), "above")
        moved = above.where("_moved").limit(1).count()
        above = above.select("node", "up")
        if not moved:
            return above
