"""Connected components of an undirected graph given by edges between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges (u, v) with u > v in and out."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of an edge but those that are the least of their component: label is the
    component's least node. ``edges`` has two long columns; direction, loops and repeats don't matter, edges with a
    null are left out. No edges, no rows.

    Large-star and small-star steps in turn bring every node next to its component's least node in a number of
    rounds that is logarithmic in practice. Each round is cut off from the last by a checkpoint, and only a
    count and a hash come to the driver. Minima are taken before the shuffle, so a node with very many edges
    is one row there; in the joins its edges are the side that adaptive execution splits.
    """
    a, b = edges.columns
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == state or sign[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state, now = sign, cut(_stars(now))
