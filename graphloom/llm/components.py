"""Connected components by alternating large-star and small-star steps, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(`node`, `root`): every node that has an edge to another one, and the smallest node it reaches.

    Nodes are numbers. Each step is an aggregation with map-side minima and an equi-join, and its
    result is written to the shared folder; a chain of n nodes takes about log n steps. Null nodes,
    loops and repeated edges are ignored.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links, before = materialise(links), None
    while True:
        size = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = size
        links = materialise(_small_star(_large_star(links)))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest one instead."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    near = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
