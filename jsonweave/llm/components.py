"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stash


def connected_components(edges: DataFrame, shelf: list[str] | None = None) -> DataFrame:
    """``edges (a, b)`` -> ``(node, component)`` for every node of an edge; component = least node reachable.

    Each round hangs every node's larger neighbours under its least neighbour, then its smaller ones;
    the edge list never grows, and paths shrink by a constant factor. Rounds go on until nothing changes. Edges of a round are written to
    the shared folder, so lineage stays short; nothing but two sums reaches the driver. ``shelf`` gets the tables that the result reads.
    """
    spark, shelf = edges.sparkSession, [] if shelf is None else shelf
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", shelf)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: all edges now point from the larger to the smaller node
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b")))
        now = stash(small.where("a <> b").distinct(), "edges", shelf)
        drop(spark, shelf.pop(-2))
        state = now.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == before:
            break
        before = state
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
