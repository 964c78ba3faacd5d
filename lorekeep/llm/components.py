"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import stored


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the smallest of u and all its v. The sums are stored, so Spark can split a hub in the join."""
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "star")
    return pairs.join(least, "u").withColumn("m", F.least("m", "u"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected(links: DataFrame) -> DataFrame:
    """Links (a, b) of whole numbers -> (node, component) for every node with a link to another: its smallest reachable node.

    Links with a null end and links of a node to itself say nothing. Repeated links count once. No links give no rows.
    Each step is written to the shared folder; the number of steps grows with the logarithm of the longest chain.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _mark(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = stored(_least(both).filter("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        met = _least(down)
        small = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(met.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = stored(small.filter("a <> b").distinct(), "small-star")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
