"""Connected components of a graph of links, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import forget, written


def _nearest(edges: DataFrame) -> DataFrame:
    """(u, least): the least neighbour of each u; cut, so that the join below has a plain exchange on both sides and hot nodes can be split."""
    return written(edges.groupBy("u").agg(F.min("v").alias("least")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _nearest(both)
    out = written(both.join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")))
    forget(near)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    near = _nearest(edges)
    moved = edges.join(near, "u").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    out = written(moved.unionByName(near.select("u", F.col("least").alias("v"))).distinct())
    forget(near)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link in (a, b); component is the least node that it reaches.

    Alternates large-star and small-star steps until every node points at its least one; each round is
    written to the shared checkpoint folder.  Rounds grow with the logarithm of the longest chain.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum("v").cast("string").alias("s")).first()
        if mark == now or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = now
        large = _large_star(edges)
        small = _small_star(large)
        forget(edges, large)
        edges = small
