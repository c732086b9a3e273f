"""Nodes of a tree that is to be stored: which are left out, their classes, attributes, limits and bounds.

A node is a row with ``path``, ``name``, ``type`` (a letter, null where the node could not be
examined), ``size`` and, where they matter, ``readable`` and ``mode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions.scalars import blocks_needed, worst_case
from lamella.operators.layout import RECORD, record_size

#: The limits of a stored tree.
MAX_FILE = (1 << 32) - 1
BIG_FILE = (1 << 24) - 1
MAX_DIRECTORY = (1 << 24) - 1
MAX_NODES = (1 << 16) - 1
MAX_IMAGE = 1 << 32
POINTER = 4
#: Types by class. Sockets are left out unless they are asked for.
CLASSES = {"directory": ("d",), "file": ("f", "l"), "special": ("c", "b", "p", "s")}


def with_skip_reason(nodes: DataFrame, sockets: bool = False) -> DataFrame:
    """Adds why a node would not be stored: unknown (no type), unreadable or empty (files and links), socket; else null."""
    content = F.col("type").isin(*CLASSES["file"])
    reason = F.when(F.col("type").isNull(), "unknown").when(content & ~F.coalesce(F.col("readable"), F.lit(False)), "unreadable").when(content & (F.coalesce("size", F.lit(0)) == 0), "empty")
    if not sockets:
        reason = reason.when(F.col("type") == "s", "socket")
    return nodes.withColumn("skip_reason", reason)


def class_counts(nodes: DataFrame, sockets: bool = False) -> DataFrame:
    """class (directory, file, special or skipped), n, bytes: one row per class that occurs."""
    name = F.when(F.col("skip_reason").isNotNull(), "skipped")
    for k, types in CLASSES.items():
        name = name.when(F.col("type").isin(*types), k)
    marked = with_skip_reason(nodes, sockets).select(name.alias("class"), "size")
    return marked.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def size_verdict(size: Column, error: int = MAX_FILE, warning: int = BIG_FILE) -> Column:
    """error for a file that is too large to be stored, warning for one that is large, else ok."""
    return F.when(size > error, "error").when(size > warning, "warning").otherwise("ok")


def directory_verdicts(tree: DataFrame, limit: int = MAX_DIRECTORY) -> DataFrame:
    """parent, dir_bytes, verdict of each directory by its records' bytes (``tree``: parent, name)."""
    sums = tree.groupBy("parent").agg(F.sum(record_size("name")).alias("dir_bytes"))
    return sums.withColumn("verdict", F.when(F.col("dir_bytes") > limit, "error").otherwise("ok"))


def bound(nodes: DataFrame, codec: str, block: int) -> DataFrame:
    """n_nodes, n_pointers, data_bytes, upper_bound, too_many of all that is stored (one row).

    A node takes its record; a file or link with content takes a pointer more than it has
    blocks, and the codec's bound for each block. The bound ends at the largest image.
    """
    held = F.col("type").isin(*CLASSES["file"]) & (F.coalesce("size", F.lit(0)) > 0)
    n_blocks = F.when(held, blocks_needed(F.col("size"), block)).otherwise(F.lit(0).cast("bigint"))
    pointers = F.when(held, n_blocks + 1).otherwise(F.lit(0).cast("bigint"))
    whole = worst_case(codec, F.lit(block).cast("bigint"))
    sums = nodes.select(record_size("name").alias("record"), pointers.alias("pointers"), n_blocks.alias("blocks"), F.when(held, F.col("size")).otherwise(F.lit(0)).alias("held")).agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.coalesce(F.sum("pointers"), F.lit(0)).alias("n_pointers"),
        F.coalesce(F.sum("held"), F.lit(0)).cast("bigint").alias("data_bytes"),
        F.coalesce(F.sum(F.col("record") + F.col("pointers") * POINTER + F.col("blocks") * whole), F.lit(0)).cast("bigint").alias("exact"),
    )
    return sums.select("n_nodes", "n_pointers", "data_bytes", F.least("exact", F.lit(MAX_IMAGE)).alias("upper_bound"), (F.col("n_nodes") > MAX_NODES).alias("too_many"))


def attributes(entries: DataFrame) -> DataFrame:
    """``entries`` (type, size, data_offset, mtime) with blocks_512, device, and the three times.

    A file or link has a count of 512-byte blocks if it has data; the size of a device node is
    its number; a node's times are all that of the image.
    """
    stored = F.col("type").isin(*CLASSES["file"]) & (F.col("data_offset") != 0)
    device = F.col("type").isin("c", "b")
    return entries.select(
        "*",
        F.when(stored, blocks_needed(F.col("size"), 512)).otherwise(F.lit(0)).cast("bigint").alias("blocks_512"),
        F.when(device, F.col("size")).alias("device"),
        *(F.col("mtime").alias(c) for c in ("atime", "ctime")),
    )


def implausible(entries: DataFrame) -> DataFrame:
    """check, path: what cannot hold of a record (path, type, mode, name, size, entry_offset, data_offset).

    Files, links and directories begin at or after the end of their own record; special nodes
    have no offset; pipes and sockets no size; files and links have a size; mode and name are
    not zero or empty.
    """
    end = F.col("entry_offset") + RECORD + F.octet_length("name")
    content, special = F.col("type").isin(*CLASSES["file"]), F.col("type").isin(*CLASSES["special"])
    checks = {
        "zero_mode": F.col("mode") == 0,
        "zero_name": F.octet_length("name") == 0,
        "zero_size": content & (F.col("size") == 0),
        "offset_in_record": (content | ((F.col("type") == "d") & (F.col("size") > 0))) & (F.coalesce("data_offset", F.lit(0)) < end),
        "special_offset": special & (F.coalesce("data_offset", F.lit(0)) != 0),
        "special_size": F.col("type").isin("p", "s") & (F.col("size") != 0),
        "unknown_type": ~F.coalesce(content | special | (F.col("type") == "d"), F.lit(False)),
    }
    found = F.filter(F.array(*(F.when(test, F.lit(k)) for k, test in checks.items())), lambda x: x.isNotNull())
    return entries.select(F.explode(found).alias("check"), "path")


def pre_order(tree: DataFrame) -> DataFrame:
    """Adds ``turn``, which orders a tree's paths with every directory just before what it holds."""
    return tree.withColumn("turn", F.split("path", "/"))


def by_size(nodes: DataFrame, *ties: str) -> DataFrame:
    """Adds ``place``: the place of each node when the smallest comes first (a distributed order)."""
    from lamella.plans.numbering import ordered_total

    return ordered_total(nodes, ["size", *ties], F.lit(1), "place")
