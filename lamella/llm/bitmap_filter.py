"""Bitmap filters from Spark's bitmap functions: a small table that tells which keys may be held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.plans.spool import spool

#: Bits of a piece of a filter, bits per key, and the most bits of a filter that is broadcast (8 MB).
PIECE = 15
BITS = 32
MOST_BITS = 1 << 26


class Filter:
    """A bitmap over the hashed values of a column ``digest``, about ``count``. False positives are
    possible, false negatives are not. Beyond ``most`` bits there are more false positives."""

    def __init__(self, digests: DataFrame, count: int, most: int = MOST_BITS) -> None:
        self.bits = min(max(1 << PIECE, 1 << max(0, count * BITS - 1).bit_length()), most)
        place = self._place("digest")
        pieces = digests.select(F.shiftright(place, PIECE).alias("piece"), place.bitwiseAND(F.lit((1 << PIECE) - 1)).alias("bit")).groupBy("piece").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
        self.pieces = spool(pieces, "filter")

    def _place(self, digest: str) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.bits))

    def marked(self, rows: DataFrame, digest: str, out: str) -> DataFrame:
        """``rows`` with the column ``out``: whether the filter knows the column ``digest``."""
        place = self._place(digest)
        pieces = self.pieces.select(F.col("piece").alias("__piece"), F.col("bitmap").alias("__bitmap"))
        if self.bits <= MOST_BITS:
            pieces = F.broadcast(pieces)  # 8 MB at most, whatever the number of digests
        at = place.bitwiseAND(F.lit((1 << PIECE) - 1))
        byte = F.conv(F.hex(F.substring("__bitmap", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        known = F.coalesce(F.expr("getbit(__byte, __bit)") == 1, F.lit(False))
        joined = rows.join(pieces, F.shiftright(place, PIECE) == F.col("__piece"), "left").withColumn("__byte", byte).withColumn("__bit", at.bitwiseAND(F.lit(7)).cast("int"))
        return joined.withColumn(out, known).drop("__piece", "__bitmap", "__byte", "__bit")


def only(rows: DataFrame, key: str, wanted: DataFrame, of: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among the values of ``of`` in ``wanted`` (stored).

    Rows that need no partner are so kept from being shuffled to a join that would drop them.
    """
    held = Filter(wanted.select(F.col(of).alias("digest")), wanted.count())
    return held.marked(rows, key, "__may").where("__may").drop("__may")
