"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.lineage import cut

MAX_ROUNDS = 60


def _toward_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node to its smallest neighbour; the minimum is combined map-side."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger_only else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.join(low, "a")
    if larger_only:
        return linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))


def connected_components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``node`` and ``component`` (the smallest node id reached). ``edges`` has columns a, b."""
    work = cut(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        step = _toward_minimum(work, True).distinct()
        step = _toward_minimum(step, False).where(F.col("a") != F.col("b")).distinct()
        work = cut(step)
        mark = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("connected components did not settle")
    labels = work.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", node)
    return nodes.select(node).distinct().join(labels, node, "left").select(
        node, F.least(F.coalesce("component", node), F.col(node)).alias("component")
    )
