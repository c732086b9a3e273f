"""Joining many rows of one key with the one row that the key has on the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.plans.spool import spool

#: Rows of a key in one block.
BLOCK = 4096


def attached(rows: DataFrame, key: str, other: str, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (stored) joined with the one row of ``right`` for their key. A key of more than ``block``
    rows is joined in as many blocks as it has so many, for which its one row is copied."""
    often = rows.groupBy(key).count().where(F.col("count") > block).select(key, F.ceil(F.col("count") / block).alias("__blocks"))
    often = spool(often, "often")
    if often.isEmpty():
        return rows.join(right, key)
    blocks = F.coalesce("__blocks", F.lit(1))
    dealt = rows.join(often, key, "left").withColumn("__block", F.pmod(F.xxhash64(other), blocks)).drop("__blocks")
    copied = right.join(often, key, "left").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).drop("__blocks")
    return dealt.join(copied, [key, "__block"]).drop("__block")
