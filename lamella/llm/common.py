"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a per-worker memo may hold before it starts anew.
MEMO_ENTRIES = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


class Memo(dict):
    """A dict that computes missing values and empties itself when it is full."""

    def __init__(self, compute: Callable, limit: int = MEMO_ENTRIES) -> None:
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of each row, as Python values; a few hundred rows are held at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            some = batch.slice(start, 256)
            yield from zip(*(some.column(some.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def out_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, weight: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows or about ``weight`` bytes of binary values."""
    held: list[tuple] = []
    heavy = 0
    for row in rows:
        held.append(row)
        heavy += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= size or heavy >= weight:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, heavy = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
    held = []
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and two share an executor with its JVM."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


_kept: dict = {}


def kept(key, make: Callable):
    """What a worker process keeps between tasks: one thing at a time. That of another key is dropped first, so
    operators that follow each other do not add up their memos."""
    if key not in _kept:
        drop_kept()
        _kept[key] = make()
    return _kept[key]


def drop_kept() -> None:
    """Free what the worker keeps."""
    if _kept:
        _kept.clear()
        give_back()


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
