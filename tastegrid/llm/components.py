"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.frames import materialize

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """Rows of node and component, the smallest node reachable, for nodes of edges a-b.

    Every round hangs the larger neighbours of each node on its smallest one,
    then all smaller ones, until each tree is a star. Minima are aggregated
    before the shuffle, so a node with very many edges is no hot group. Edges
    of a node with itself and null ends are left out.
    """
    pairs = edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    pairs = materialize(pairs.where("high <> low").distinct())
    for _ in range(MAX_ROUNDS):
        both = pairs.select(F.col("high").alias("u"), F.col("low").alias("v")).union(pairs.select("low", "high"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low"))
        large = large.distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high")
        pairs = materialize(
            small.where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
            .union(least.select("high", F.col("m").alias("low")))
            .distinct()
        )
        parents = pairs.groupBy("high").agg(F.count("*").alias("n"))
        if parents.where("n > 1").isEmpty() and pairs.join(parents.select(F.col("high").alias("low")), "low", "left_semi").isEmpty():
            roots = pairs.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
            return pairs.select(F.col("high").alias("node"), F.col("low").alias("component")).union(roots)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
