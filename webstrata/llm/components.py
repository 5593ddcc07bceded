"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node itself, goes to the smallest."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    below = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node but the least of its component, the label.

    ``edges`` has comparable columns ``a`` and ``b``; self-loops, repeated edges
    and either direction are accepted, rows with a NULL end are no edge, and an
    empty table gives an empty table. Each round is written below the shared
    checkpoint folder, so a lost executor never reaches back over a round. A
    node's edges are never gathered: minima are map-side aggregates and the
    joins are plain equi-joins that may be split when one node has most edges.
    """
    now = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        mark = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = mark
        if mark["n"]:
            now = cut_lineage(_small_star(_large_star(now)).distinct())
