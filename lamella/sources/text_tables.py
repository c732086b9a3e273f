"""Path lists, benchmark logs and device tables as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.scalars import device_major, device_minor, seconds
from lamella.operators import devices
from lamella.sources.directory import TreeSource

BENCH = "fstype string, name string, cmd string, real string, user string, sys string"


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """One path per line, right-trimmed; blank lines are left out."""
    return spark.read.text(path).select(F.rtrim(F.regexp_replace("value", r"\s+$", "")).alias("path")).where("path <> ''")


def bench_log(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark log with its durations in seconds; malformed rows fail the read."""
    raw = spark.read.csv(path, schema=BENCH, mode="FAILFAST")
    return raw.select("fstype", "name", "cmd", *(seconds(F.col(c)).alias(c) for c in ("real", "user", "sys")))


def device_table(spark: SparkSession, path: str) -> DataFrame:
    return devices.parse(spark.read.text(path))


def directory_table(spark: SparkSession, root: str) -> DataFrame:
    """The device table rows of a directory tree: its directories, devices and pipes."""
    spark.dataSource.register(TreeSource)
    nodes = spark.read.format("tree").option("path", root).load().where(F.col("type").isin("d", "c", "b", "p"))
    number = F.coalesce("device", F.lit(0))
    return nodes.select(F.concat(F.lit("/"), "path").alias("path"), "type", F.col("mode").bitwiseAND(F.lit(0o7777)).alias("mode"), "uid", "gid", device_major(number).alias("major"), device_minor(number).alias("minor"))


def write_device_table(rows: DataFrame, path: str) -> None:
    """Ten tab-separated fields per row; absent numbers are ``-``."""
    fields = [F.coalesce(F.conv(F.col(c).cast("string"), 10, 8) if c == "mode" else F.col(c).cast("string"), F.lit("-")) if c in rows.columns else F.lit("-") for c in devices.FIELDS]
    rows.where(F.col("type").isin("d", "c", "b", "p")).select(F.concat_ws("\t", *fields)).write.text(path)
