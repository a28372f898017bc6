"""Connected components of an edge list, in logarithmic rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import saved

MAX_ROUNDS = 60


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``a``, ``b``; any type with an
    order): the least node of its component.

    Alternates two star steps: larger neighbours are hung below the least
    neighbour, then smaller ones are. A node's least neighbour is found by an
    aggregation that folds map-side, so a node with very many neighbours is no
    hot spot. Stops when a round changes nothing.
    """
    now = saved(edges.filter("a != b").select(F.greatest("a", "b").alias("a"),
                                              F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        # Large star: neighbours above u move below u's least neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a != b").distinct())
        # Small star: of what lies below u, everything moves below the least.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b")))
                 .filter("a != b").distinct())
        now = saved(small, "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
                    .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
