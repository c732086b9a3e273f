"""Content deduplication and the sizes that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.scalars import blocks_needed, size_of, worst_case


def sized(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, size, digest of each file."""
    return files.select(F.col(key).alias("key"), size_of(content).alias("size"), F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("digest"))


def content_classes(files: DataFrame, key: str, content: str) -> DataFrame:
    """size, digest, leader (smallest key), members of each distinct content.

    Partial aggregation sends one row per content and task; the contents do not shuffle.
    """
    return sized(files, key, content).groupBy("size", "digest").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("members"))


def leaders(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, size, leader, duplicate of each file."""
    classes = content_classes(files, key, content).select(F.col("digest").alias("__d"), F.col("size").alias("__s"), "leader")
    rows = sized(files, key, content)
    return rows.join(classes, (F.col("digest") == F.col("__d")) & (F.col("size") == F.col("__s"))).select("key", "size", "leader", (F.col("key") != F.col("leader")).alias("duplicate"))


def totals(files: DataFrame, key: str, content: str, block: int) -> DataFrame:
    """Files, bytes, distinct bytes, duplicates, blocks and the zlib bound of a set of files."""
    classes = content_classes(files, key, content)
    return classes.agg(
        F.sum("members").alias("n_files"),
        F.sum(F.col("size") * F.col("members")).alias("total_bytes"),
        F.sum("size").alias("distinct_bytes"),
        F.sum(F.col("members") - 1).alias("n_duplicates"),
        F.sum(blocks_needed(F.col("size"), block) * F.col("members")).alias("n_blocks"),
        F.sum(worst_case("zlib", F.lit(block).cast("bigint")) * blocks_needed(F.col("size"), block)).alias("upper_bound"),
    )


def skip_reason(size: DataFrame) -> DataFrame:
    """Adds why a node would not be stored: unreadable (null size), empty, or null for a kept one."""
    return size.withColumn("skip_reason", F.when(F.col("size").isNull(), "unreadable").when(F.col("size") == 0, "empty"))
