"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmill.session import stage


def _mark(edges: DataFrame) -> tuple:
    """A digest of an edge set that two rounds can be compared by."""
    total = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), total).first())


def _plain(links: DataFrame, a: str, b: str) -> DataFrame:
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    return pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours the smallest node it sees."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, component) per node that has a link; component is the smallest node reachable.

    ``links`` holds undirected pairs of numeric ids; loops, repeats and pairs with a null end add
    nothing. The minima are combined before the shuffle and each round is checkpointed, so neither
    a node with very many links nor a lost executor is a problem. An empty table gives no rows.
    """
    edges = stage(_plain(links, a, b))
    mark = _mark(edges)
    while mark[0]:
        edges = stage(_small_star(_large_star(edges)))
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
