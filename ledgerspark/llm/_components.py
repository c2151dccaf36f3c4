"""Connected components of an edge table, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm._tables import kept


def _stars(edges: DataFrame) -> bool:
    """Whether every node either has one smaller neighbour alone or larger ones alone: then the smaller one is its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return each.where("up > 1 OR up > 0 AND least = 0").agg(F.count(F.lit(1)).alias("n")).first().n == 0


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a bigint, b bigint).

    Alternates two steps until the edges are stars around smallest nodes: every node's larger neighbours move to its
    least neighbour, then its smaller ones do. Each round is written to the shared folder; edges that are stars
    need none. A node with very many neighbours costs one aggregated row per task and a join that Spark can split.
    """
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("to").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("to"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("to").alias("b")).unionByName(least.select("a", F.col("to").alias("b")))
        now = kept(small.where("a <> b").distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
