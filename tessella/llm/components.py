"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise


def _is_stars(edges: DataFrame) -> bool:
    """Every child has one parent, and no parent is a child."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 OR (c > 0 AND p > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): the smallest node v that node u > v can reach, from edges u, v of longs.

    Alternating star operations: each node's larger neighbours, then its
    smaller ones, are linked to the smallest it knows.  Minima are combined
    before the shuffle, so a node with very many neighbours is no bottleneck.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", "m")).distinct()
        edges = materialise(small, "edges")
    return edges
