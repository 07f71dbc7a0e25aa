"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Edges (a, b) -> (node, component): the smallest node that each node is connected to. Isolated nodes have no row.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each joins every node's neighbours to
    the least of them, which leaves a star a component in O(log^2 n) rounds. Every round is written to the shared
    folder; only counts reach the driver. A hub's neighbours are aggregated to one minimum before they are joined, and
    the minima are written as a table: both sides of each join then come from plain exchanges, whose skewed
    partitions Spark splits, so a hub's edges are not one task's work.
    """
    e = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(most_rounds):
        # large star: each node's larger neighbours go to the least of itself and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        e = stash(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: each node and its smaller neighbours go to the least of these
        least = stash(e.groupBy("u").agg(F.min("v").alias("m")))
        down = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stash(down.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"no stable components after {most_rounds} rounds")
