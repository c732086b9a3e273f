"""Rendezvous hashing of record keys over weighted shards.

Every shard scores every key with a hash of (key, shard); the highest score wins.
A new shard can only win keys for itself, so growing from n to n + 1 shards moves
about 1/(n + 1) of the records and none between old shards. A shard of weight w
gets a share in proportion to w (score -w / ln u).

Special rows: a null text has size 16 and CRC 0; rows with a null doc_id share one
key; repeated rows go to one shard and get slots of their own; extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.plans.numbering import number_rows
from lamella.plans.spool import spool

#: Hash bits used for u in (0, 1): with a half added they are still exact in a double, so u is never 0 or 1.
BITS = 52


def score(key: Column, shard: Column, weight: Column) -> Column:
    """-w / ln(u), with u from a hash of key and shard; larger wins."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard), 64 - BITS)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << BITS))
    return -weight / F.log(u)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 ... n - 1) that wins the key; ties go to the smaller shard."""
    scored = [F.struct(score(key, F.lit(s), F.lit(float(w))).alias("score"), F.lit(-s).alias("minus")) for s, w in enumerate(weights) if w > 0]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["minus"]).cast("int")


def assign(docs: DataFrame, weights: list[float], new_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard (with one more shard of ``new_weight``).

    The winner of the first n shards is found once; the grown shard only compares it
    with the new shard's score.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    n = len(weights)
    rows = docs.select(F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), rendezvous(key, weights).alias("shard"))
    by_weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("shard") + 1)
    grown = F.when(score(key, F.lit(n), F.lit(new_weight)) > score(key, F.col("shard"), by_weight), F.lit(n)).otherwise(F.col("shard"))
    return rows.withColumn("grown_shard", grown.cast("int"))


def shards(docs: DataFrame, weights: list[float]) -> DataFrame:
    """``assign`` with ``slot``: gapless positions from 0 within each shard."""
    placed = spool(assign(docs, weights), "shards")
    return number_rows(placed, ["shard"], ["doc_id", "text_crc32"], "slot", placed.count(), len(weights))


def write_shards(docs: DataFrame, weights: list[float], path: str) -> None:
    """Write the documents into one folder per shard, all columns kept."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs.withColumn("__shard", rendezvous(key, weights)).write.partitionBy("__shard").parquet(path)
