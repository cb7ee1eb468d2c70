"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node reachable, for every node with a link.

    ``links`` has two columns of one type, ``a`` and ``b``; order, repeats and
    loops do not matter.  Each round points every node at its smallest
    neighbour, follows the pointers three steps and keeps the links whose ends
    still differ.  A round at least halves the nodes of a star and shortens a
    chain fourfold.  All tables of a round are written to the shared folder;
    the driver holds only the number of links left.  Joins read written
    tables, so adaptive execution can split the links of a hub.
    """
    one = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = materialize(links.where(F.col("a") != F.col("b")).select(*one).distinct(), "links")
    steps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min("b").alias("b"))
        nearest = materialize(nearest.select(F.col("a").alias("node"), F.least("a", "b").alias("next")), "nearest")
        for _ in range(2):
            far = nearest.select(F.col("node").alias("next"), F.col("next").alias("after"))
            nearest = nearest.join(far, "next").select("node", F.col("after").alias("next"))
        nearest = materialize(nearest, "pointers")
        steps.append(nearest)
        for end in ("a", "b"):
            edges = edges.join(nearest.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("next", end)
        edges = materialize(edges.where(F.col("a") != F.col("b")).select(*one).distinct(), "links")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = steps[0].withColumnRenamed("next", "label")
    for step in steps[1:]:
        moved = step.select(F.col("node").alias("label"), F.col("next").alias("_to"))
        found = found.join(moved, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    return found
