"""Directory trees as rows: nodes from paths, totals, recursion, lookup and listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import paths as P
from lamella.operators.layout import record_size
from lamella.plans.spool import spool


def nodes(leaves: DataFrame, path: str) -> DataFrame:
    """Distinct nodes of all prefixes of the paths: path, parent, name, depth."""
    parts = leaves.select(P.components(F.col(path)).alias("parts")).where(F.size("parts") > 0)
    each = parts.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    named = each.select(
        F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path"),
        F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), "/").alias("parent"),
        F.element_at("parts", F.col("depth")).alias("name"),
        "depth",
    )
    return named.distinct()


def directory_sizes(tree: DataFrame) -> DataFrame:
    """Entries and record bytes of each directory."""
    return tree.groupBy("parent").agg(F.count(F.lit(1)).alias("n_entries"), F.sum(record_size("name")).alias("dir_bytes"))


def subtree_totals(leaves: DataFrame, path: str, size: str) -> DataFrame:
    """Leaves and bytes below each node; a path without components is below none."""
    parts = leaves.select(P.components(F.col(path)).alias("parts"), F.col(size).alias("size")).where(F.size("parts") > 0)
    each = parts.select("parts", "size", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    return each.groupBy(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path")).agg(F.count(F.lit(1)).alias("n_leaves"), F.sum("size").alias("total_bytes"))


def walked(spark: SparkSession, tree: DataFrame) -> DataFrame:
    """path, depth of each node that a walk down from the top directories reaches.

    Each round doubles the steps that a node has gone up towards the top, so that the rounds
    grow with the logarithm of the deepest level and no limit on rows or levels applies.
    Nodes below a missing parent, or on a loop, are not reached.
    """
    now = spool(tree.select("path", F.col("parent").alias("up"), F.lit(1).alias("depth")), "walk")
    for _ in range(now.count().bit_length()):
        going = now.where("up <> ''")
        if going.isEmpty():
            break
        above = now.select(F.col("path").alias("__at"), F.col("up").alias("__up"), F.col("depth").alias("__more"))
        gone = going.join(above, F.col("up") == F.col("__at")).select("path", F.col("__up").alias("up"), (F.col("depth") + F.col("__more")).alias("depth"))
        now = spool(now.where("up = ''").unionByName(gone), "walk")
    return now.where("up = ''").select("path", "depth")


def lookup(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (path) with found and depth; a missing path gives a negative row."""
    known = tree.select(F.col("path").alias("__path"), "depth")
    return wanted.join(known, F.col("path") == F.col("__path"), "left").select("path", F.col("__path").isNotNull().alias("found"), "depth")


def page_after(tree: DataFrame, cursor: tuple[str, str], n: int) -> DataFrame:
    """The next ``n`` entries after the (parent, name) cursor, in listing order."""
    after = (F.col("parent") > cursor[0]) | ((F.col("parent") == cursor[0]) & (F.col("name") > cursor[1]))
    return tree.where(after).orderBy("parent", "name").limit(n).select("parent", "name")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, as bags, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
