"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourstat.llm.common import durable


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller end; loops and NULL ends dropped."""
    return (
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    joined = links.join(least, F.col("a") == F.col("k"))
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select(F.col("k").alias("a"), F.col("m").alias("b"))
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of a link (columns ``a, b``, long): root is the smallest node reachable.

    Large-star and small-star steps alternate until the links no longer change; the number
    of rounds grows with the logarithm of the longest path. Hubs are folded by map-side
    minima and their joins split by size. Each round is checkpointed, so a lost executor
    repeats one round. An empty table gives an empty result; repeated links count once.
    """
    now = durable(_tidy(links.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    seen = None
    while True:
        # Sums of two hashes tell whether anything moved; decimals cannot overflow.
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))
        ).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        now = durable(_small_star(_tidy(_large_star(now))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
