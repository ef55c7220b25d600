"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One pass. Neighbours meet their group's minimum by a join, so no group is gathered in a row."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # a table of its own: the join below may then split a node that has many neighbours
    least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    met = both.join(least, "u")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): the least node that it reaches.

    Nodes that are their own component's least are not listed. Null ends are ignored; repeated edges and
    loops change nothing. An empty table gives an empty table.
    """
    now = checkpointed(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:  # the stars settle in a number of rounds that grows with the logarithm of the nodes
        now = checkpointed(_star(_star(now, True), False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
