"""Intermediate tables written to the folder that all executors share.

A spooled table cuts lineage the way ``checkpoint()`` does, but as compressed
Parquet: later stages prune its columns, and a lost executor costs nothing that
has to be computed again. Every application has a folder of its own; ``scratch`` gives a
step of it one that is deleted when the step is done, ``release`` deletes all.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
_SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a fresh temporary folder only on a local master where it is unset."""
    named = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CONF} must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lamella-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lamella/{spark.sparkContext.applicationId}"


def spool_path(spark: SparkSession, name: str) -> str:
    """A new path under the application's folder."""
    return f"{_own_dir(spark)}{_SCRATCH.get()}/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as read back from the shared folder."""
    path = spool_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables spooled within are deleted at the end; results must have been written elsewhere by then."""
    name = f"{_SCRATCH.get()}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(name)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        _delete(spark, f"{_own_dir(spark)}{name}")


def release(spark: SparkSession) -> None:
    """Delete every table that this application has spooled, once no DataFrame needs them."""
    _delete(spark, _own_dir(spark))
