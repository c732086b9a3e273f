"""Gapless numbering and running totals without one task per group.

A window over a group sends the whole group to one task. Here each group is cut
into hash buckets: bucket totals are added up in a small window, and the rows are
only ordered within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str, rows: int, groups: int, per_bucket: int = 50_000) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each group.

    ``df`` is read twice, so it should be a stored table. ``rows`` and ``groups`` set
    the number of buckets, so that one holds about ``per_bucket`` rows even when a
    single group holds all rows. Rows are ordered by bucket, then by ``order``.
    """
    buckets = max(1, min(1 << 20, rows // per_bucket, 64 * max(1, rows // (per_bucket * max(1, groups)))) if groups > 1 else rows // per_bucket)
    return running_total(df, group, order, F.lit(1), out, buckets)


def running_total(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, buckets: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group (bigint)."""
    cut = df.withColumn(BUCKET, F.pmod(F.xxhash64(*order), F.lit(max(1, buckets))).cast("int"))
    keys = [*group, BUCKET]
    totals = cut.groupBy(*keys).agg(F.sum(value.cast("bigint")).alias("__total"))
    before = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(base, same, "left")
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value.cast("bigint")).over(within), F.lit(0))).drop(BUCKET, "__base", *(f"__k{i}" for i in range(len(keys))))


def ordered_total(df: DataFrame, order: list[str], value: Column, out: str, partitions: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in the global ``order``.

    Rows are dealt by ranges of the order and stored with their range's number; the ranges'
    totals are added up in a small window, and each range is ordered on its own.
    """
    from lamella.plans.spool import spool

    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    stored = spool(dealt.withColumn("__range", F.spark_partition_id()), "ordered")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("__range").agg(F.sum(value.cast("bigint")).alias("__sum"))
    base = totals.select(F.col("__range").alias("__of"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = stored.join(base, F.col("__range") == F.col("__of"))
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value.cast("bigint")).over(within), F.lit(0))).drop("__range", "__of", "__base")


def ordered_lag(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the row before this one in the global ``order``; null for the first.

    As in ``ordered_total``, rows are dealt by ranges; only the last row of each range travels
    to the next one.
    """
    from lamella.plans.spool import spool

    stored = spool(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ordered")
    lasts = stored.groupBy("__range").agg(F.max_by(F.struct(value.alias("value")), F.struct(*order)).alias("__last"))
    base = lasts.select(F.col("__range").alias("__of"), F.lag("__last").over(Window.orderBy("__range")).alias("__base"))
    before = F.lag(F.struct(value.alias("value"))).over(Window.partitionBy("__range").orderBy(*order))
    joined = stored.withColumn("__lagged", before).join(base, F.col("__range") == F.col("__of"))
    return joined.withColumn(out, F.coalesce("__lagged", "__base")["value"]).drop("__range", "__of", "__lagged", "__base")
