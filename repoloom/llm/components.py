"""Connected components of a graph given as edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that has an edge; component is its smallest id.

    In: a long, b long.  Alternates large stars (every larger neighbour of a node moves
    to the node's smallest one) and small stars (a node and its smaller neighbours
    move to the smallest) until every node points at its smallest.  Minima are combined
    before each shuffle, and a hub's edges are joined, never gathered.
    """
    pairs = common.stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "edges",
    )
    while not _are_stars(pairs):
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (
            both.join(least, "a")
            .filter("b > a and b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        pairs = common.stored(small, "edges")
    roots = pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def _are_stars(pairs: DataFrame) -> bool:
    """Whether no node has two smaller ones, or is both smaller and larger than another."""
    ends = pairs.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(pairs.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or up + down > 1").isEmpty()
