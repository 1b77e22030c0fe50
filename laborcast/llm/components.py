"""Connected components of an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v.

    The large step links every larger neighbour of a node to the node's smallest neighbour (itself included); the small
    step links a node and its smaller neighbours to the smallest of them. Minima are aggregated before they are joined
    back, so a node with very many neighbours is no single task's work.
    """
    if large:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("least"))
        joined = both.where("m > n").join(least, "n")
        return joined.select(F.col("m").alias("u"), F.col("least").alias("v")).where("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    joined = edges.join(least, "u")
    return (joined.where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionAll(least.select("u", F.col("least").alias("v"))).distinct())


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has an edge to another one; the root is the smallest node of its component.

    Loops and rows with a null end are ignored, repeated and reversed edges count once. Each round is written to the
    checkpoint folder; the rounds end when a round changes no edge. No edges give no rows.
    """
    a, b = F.col(left), F.col(right)
    edges = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen or not state.n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        edges = cut(_stars(_stars(edges, large=True), large=False))
