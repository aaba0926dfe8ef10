"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import stored


def _jumped(up: DataFrame) -> DataFrame:
    """Each vertex's target's target, for a table (u, m) in which every target is a vertex."""
    return up.alias("a").join(up.alias("b"), F.col("a.m") == F.col("b.u")).select(F.col("a.u").alias("u"), F.col("b.m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest vertex of each vertex's component, for edges (u, v) of longs.

    Every round points each vertex at its smallest neighbour, follows the
    pointers twice, and goes on with the edges between different targets, which
    shrink geometrically. Minima are combined inside the tasks, so a hub costs
    no more than its edges.
    """
    labels, left = None, stored(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = stored(_jumped(_jumped(up)), "pointers")
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("m").alias("comp"))
        else:
            moved = labels.join(up, labels["comp"] == up["u"], "left")
            labels = stored(moved.select("node", F.coalesce("m", "comp").alias("comp")), "labels")
        to = lambda side: up.select(F.col("u").alias(side), F.col("m").alias(f"{side}m"))
        next_ = left.join(to("u"), "u").join(to("v"), "v").filter("um <> vm").select(F.least("um", "vm").alias("u"), F.greatest("um", "vm").alias("v"))
        left = stored(next_.distinct(), "edges")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).limit(0)
    return labels
