"""Connected components of a table of links, by alternating large and small stars.

Every round rewrites the links so that each node points to smaller ones; after a number
of rounds that grows with the logarithm of the longest chain, all nodes of a component
point to its smallest one. Only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.plans.spool import spool


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, F.col("a") == F.col("node")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    low = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
    others = links.join(low, F.col("a") == F.col("node")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(low.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of ``links`` (a, b: bigint) that is not its component's smallest."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = spool(now, "links")
    state = _state(now)
    if not state[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        now = spool(_small(_large(now)), "links")
        before, state = state, _state(now)
        if before == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
