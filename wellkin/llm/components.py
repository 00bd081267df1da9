"""Connected components of a table of edges, by alternating star contraction.

Each round points every node at the smallest node it can see (first over its larger, then over
its smaller neighbours).  Neighbourhoods are reduced to a minimum before they are joined back,
so no node's list of neighbours is ever gathered; rounds are cut by stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellkin.plans.stored import store

#: Rounds grow with the logarithm of the longest chain; this is a guard against a defect.
MOST_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    met = down.join(least, "a")
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))
    )


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node it reaches."""
    now = store(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        stars = _small_star(_large_star(now)).filter("a <> b").distinct()
        now = store(stars, "edges")
        count, total = now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if (count, total) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (count, total)
    raise RuntimeError("components did not settle")
