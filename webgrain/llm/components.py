"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm._spark import cut, drop


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one edge and is no smaller end, so that all edges (a > b) point to their component's least node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.filter("up > 1 OR (up = 1 AND down = 1)").limit(1).count() == 0


def _hook(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, m): each pair with the least m of a and its neighbours; and the cut that it reads.

    The least ones are cut first: the join then deals out pairs anew, and Spark
    may split those of a node with very many neighbours.
    """
    least = cut(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return pairs.join(least, "a"), least


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b: long): label is the least node that they reach.

    Alternating large and small stars: each round lets a node's larger, then its
    smaller neighbours point to the least node near it, until
    every tree is a star. Rounds are aggregations and joins on edges, each
    cut to the shared folder; a node with very many neighbours is a hot key of an
    inner join, which Spark may split. Nulls and loops are left out.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(edges.distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked, near = _hook(both)
        large = cut(hooked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        drop(edges, near)
        hooked, near = _hook(large)
        small = hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hooked.select("a", F.col("m").alias("b")))
        edges = cut(small.filter("a <> b").distinct())
        drop(large, near)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
