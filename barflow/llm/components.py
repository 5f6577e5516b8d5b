"""Connected components by alternating large-star and small-star passes (public algorithm), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import HOT, Scratch, join_hot


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(edges: DataFrame, total: int, or_self: bool) -> DataFrame:
    """Edges (a, b, m) with the least neighbour of a (or a itself): a star's centre has many edges, so hot nodes are joined apart."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hot = least.filter(F.col("n") >= max(2, -(-total // HOT))).select("a")
    return join_hot(edges, least.select("a", (F.least("a", "m") if or_self else F.col("m")).alias("m")), "a", hot)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of undirected edges (a, b) of longs; root is the component's smallest node.

    Each pass is written, so lineage stays short; what is aggregated before a join is one row a node.
    """
    held = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _sum(held)
    while seen[0]:
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = scratch.keep(_with_least(both, 2 * seen[0], True).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        met = _with_least(large, large.count(), False)
        small = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b"))).distinct()
        new = scratch.keep(small)
        scratch.drop(held, large)
        held, before = new, seen
        seen = _sum(held)
        if seen == before:
            break
    return held.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
