"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step keeps the components and shortens the paths to the smallest node, until every node hangs on it. Steps are written
to the shared folder, so lost executors cost one step. Hubs are joined, never gathered, so Spark can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..session import materialize
from .stored import discard


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and their number and a sum of their hashes, observed on the way."""
    seen = Observation()
    stored = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges", broadcasts=False)
    return stored, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """node and component (its smallest node) of every node of the edges (columns a, b). Loops and repeats are allowed;
    null ends are no nodes."""
    clean = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now, before = _written(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_steps if before[0] else 0):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, (now, after) = now, _written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_steps} steps")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def grown(known: DataFrame, edges: DataFrame) -> DataFrame:
    """The components that `known` ones make with further edges: their stars stand for the edges they came of, so few steps are left."""
    return connected_components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(edges.select("a", "b")))
