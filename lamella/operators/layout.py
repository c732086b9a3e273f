"""Block and record layouts: running offsets in a global order, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.scalars import blocks_needed
from lamella.plans.numbering import ordered_lag, ordered_total

RECORD = 15


def blocks(files: DataFrame, block: int) -> DataFrame:
    """One row per block of each file (any columns, ``size``): blk_nr, blk_offset, blk_length."""
    n = blocks_needed(F.col("size"), block)
    some = files.where(F.col("size") > 0).withColumn("blk_nr", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return some.withColumn("blk_offset", F.col("blk_nr") * block).withColumn("blk_length", F.least(F.lit(block), F.col("size") - F.col("blk_offset")).cast("bigint"))


def pointers(parts: DataFrame, order: list[str], length: str, start: int = 0) -> DataFrame:
    """Adds ``ptr``: where each part begins when all follow each other in ``order``."""
    return ordered_total(parts, order, F.col(length), "ptr").withColumn("ptr", F.col("ptr") + start)


def lengths(placed: DataFrame, file: list[str], order: str, end: str) -> DataFrame:
    """Adds ``length``: from each pointer to the file's next one, or to ``end`` at its last."""
    following = F.lead("ptr").over(Window.partitionBy(*file).orderBy(order))
    return placed.withColumn("length", F.coalesce(following, F.col(end)) - F.col("ptr"))


def record_size(name: str):
    return (F.lit(RECORD) + F.octet_length(name)).cast("bigint")


def covering_blocks(requests: DataFrame, page: int, block: int) -> DataFrame:
    """The blocks that hold each page (``page_nr``): one row per page and block."""
    first = F.floor(F.col("page_nr") * page / F.lit(block))
    last = F.floor((F.col("page_nr") * page + (page - 1)) / F.lit(block))
    return requests.withColumn("blk_nr", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))


def shares(placed: DataFrame, offset: str, *sizes: str) -> DataFrame:
    """The offsets that more than one file begins at: n, consistent (all have the same sizes), and as
    ``saved_<size>`` what all but one of them would have taken.

    Files of one offset are compared by their extremes, so a hot offset is pre-aggregated in
    every task and no order is needed.
    """
    both = F.struct(*sizes)
    found = placed.groupBy(offset).agg(F.count(F.lit(1)).alias("n"), (F.min(both) == F.max(both)).alias("consistent"), *((F.sum(c) - F.min(c)).alias(f"saved_{c}") for c in sizes))
    return found.where("n > 1")


def adjacent_shares(placed: DataFrame, offset: str, tie: str, *sizes: str) -> DataFrame:
    """``placed`` in the order of its offsets (then of ``tie`` and the sizes), with ``shared`` (the file before has the same offset) and
    ``strange`` (it has, but other sizes)."""
    before = ordered_lag(placed, [offset, tie, *sizes], F.struct(offset, *sizes), "__before")
    same = F.coalesce(F.col("__before")[offset] == F.col(offset), F.lit(False))
    alike = F.lit(True)
    for c in sizes:
        alike = alike & (F.col("__before")[c] == F.col(c))
    return before.withColumn("shared", same).withColumn("strange", same & ~alike).drop("__before")


def disorder(tree: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``tree`` with ``ordered``: whether the first byte of the name is not below that of the entry before in its group."""
    first = F.hex(F.substring(F.col(name).cast("binary"), 1, 1))
    before = ordered_lag(tree, [group, order], F.struct(F.col(group).alias("group"), first.alias("first")), "__before")
    lower = (F.col("__before")["group"] == F.col(group)) & (first < F.col("__before")["first"])
    return before.withColumn("ordered", ~F.coalesce(lower, F.lit(False))).drop("__before")
