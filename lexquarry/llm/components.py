"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import shared


def _stars(edges: DataFrame) -> bool:
    """Whether every node but the smallest of its component has one edge, and that to the smallest: no node is the
    larger end of two edges, or of one and the smaller end of another."""
    ends = edges.select("u", F.lit(1).alias("n")).union(edges.select("v", F.lit(None).cast("int")).distinct())
    return ends.groupBy("u").agg(F.count("*").alias("rows"), F.count("n").alias("larger")).where("larger > 0 and rows > 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node. Null ends are left out.

    Nothing but whether it is done reaches the driver in a round. Smallest neighbours are aggregated before their shuffle and
    joined back, so a node with very many edges is never one group.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct()
    e = shared.checkpointed(e)
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        e = shared.checkpointed(small)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
