"""Connected components of a graph given as a table of edges, by alternating star contractions.

Each round links the larger neighbours of a node to its smallest neighbour, then the smaller ones.
Both are a minimum for each node (pre-aggregated before the shuffle) and a join, so that a node with
very many neighbours is never collected. Each round is written to the shared folder. When the edges
are stars around their smallest node, the components are found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node and component (the smallest node that it is linked with) of each node that isn't its component's smallest."""
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    step = 0
    while True:
        # Stars: a larger end has one smaller end only, and a smaller end is no larger end of another.
        ends = now.select(F.col("a").alias("u"), "b").unionAll(now.select(F.col("b").alias("u"), F.lit(None).cast("long").alias("b")))
        seen = ends.groupBy("u").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count_if(F.col("b").isNull()).alias("below"))
        if seen.where("low <> high OR (low IS NOT NULL AND below > 0)").limit(1).count() == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = _both(now)
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Each edge now leads to a smaller node; link the smaller neighbours to the smallest of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        step += 1
        now = scratch.save(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
