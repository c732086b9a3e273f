"""What caches and shared states would do on a trace of accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.plans.numbering import ordered_total
from lamella.plans.spool import spool


def last_access_hits(trace: DataFrame, order: list[str], key: str) -> DataFrame:
    """accesses, hits of a cache that holds the last key only.

    The order is global, so the trace is dealt by ranges; the key before a range's first
    access comes from the last access of the ranges before it.
    """
    stored = spool(trace.select(*order, F.col(key).alias("key")).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "trace")
    within = Window.partitionBy("part").orderBy(*order)
    here = stored.withColumn("before", F.lag("key").over(within)).withColumn("n", F.row_number().over(within))
    ends = stored.groupBy("part").agg(F.max(F.struct(*order, "key"))["key"].alias("last"))
    carried = ends.select(F.col("part").alias("of"), F.lag("last").over(Window.orderBy("part")).alias("carried"))
    joined = here.join(carried, F.col("part") == F.col("of"))
    before = F.when(F.col("n") == 1, F.col("carried")).otherwise(F.col("before"))
    return joined.agg(F.count(F.lit(1)).alias("accesses"), F.sum(F.coalesce((before == F.col("key")).cast("bigint"), F.lit(0))).alias("hits"))


def shared_users(mounts: DataFrame, key: list[str]) -> DataFrame:
    """States that mounts with one key share, and what sharing saves."""
    return mounts.groupBy(*key).agg(F.count(F.lit(1)).alias("users"), (F.count(F.lit(1)) - 1).alias("saved"))


def live_users(changes: DataFrame, key: str, order: list[str], delta: str) -> DataFrame:
    """Adds ``live``: acquired minus released so far, per key.

    The sum runs over all keys in their order, in ranges; what a key begins with is taken off,
    so a key with most of the changes is not gathered in one task.
    """
    summed = ordered_total(changes, [key, *order], F.col(delta), "__before")
    begins = summed.groupBy(F.col(key).alias("__key")).agg(F.min_by("__before", F.struct(*order)).alias("__begin"))
    joined = summed.join(begins, F.col(key).eqNullSafe(F.col("__key")))
    return joined.withColumn("live", F.col("__before") + F.col(delta) - F.col("__begin")).drop("__before", "__key", "__begin")
