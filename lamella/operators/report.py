"""Benchmark reports: grouped averages, their pivot, best-of choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.scalars import quantised


def averages(log: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Averages of DECIMAL values per key, with four decimals, half to even; in the order of the keys.

    The number of reports is that of the keys, so their order is a small sort.
    """
    n = F.count(F.lit(1))
    return log.groupBy(*keys).agg(n.alias("n"), *(quantised(F.sum(v).cast("double") / n).alias(f"avg_{v}") for v in values)).orderBy(*keys)


def pivoted(log: DataFrame, rows: str, column: str, names: list, value: str) -> DataFrame:
    """The averages with a column per name."""
    picks = [F.col(column) == F.lit(n) for n in names]
    return log.groupBy(rows).agg(*(quantised(F.sum(F.when(p, F.col(value))).cast("double") / F.count(F.when(p, 1))).alias(f"avg_{n}") for p, n in zip(picks, names, strict=True)))


def smallest(candidates: DataFrame, key: str, choice: str, length: str, rank: str) -> DataFrame:
    """The choice with the least length per key; the first in rank on ties."""
    return candidates.groupBy(key).agg(F.min(length).alias("best_length"), F.min_by(choice, F.struct(length, rank)).alias("best"))
