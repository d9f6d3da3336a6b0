"""Connected components of a graph by star contraction.

Each round hangs every node's neighbours from its least one, first the larger ones, then the smaller ones with the node itself. Distances to
the least node of a component shrink by a factor, so a chain of n nodes takes about log n rounds; an edge list never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.session import durable


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the least of the node and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for all nodes of ``edges`` (``a``, ``b``)."""
    stars, before = edges.select("a", "b").where("a <> b").distinct(), None
    while True:
        stars = durable(_small_star(_large_star(stars)))
        now = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    members = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
