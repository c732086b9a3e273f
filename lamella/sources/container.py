"""Block containers as tables: build, check, read back.

A container is four tables instead of one byte stream: ``entries`` (a record per file, with
its record and data offsets), ``blocks`` (encoded blocks with pointer and length), and one
row of totals. Offsets are what they would be in a file, so each block can be read alone.
Equal contents are stored once. The global order is only used for running offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.scalars import ratio_change, size_of, worst_case
from lamella.operators.layout import blocks, pointers, record_size
from lamella.plans.spool import spool
from lamella.sources.codecs import decoded, encoded

SUPERBLOCK = 77
POINTER = 4


@dataclass
class Container:
    entries: DataFrame
    blocks: DataFrame
    codec: str
    block: int

    def totals(self) -> DataFrame:
        """n_entries, metadata_bytes, n_blocks, data_bytes, plain_bytes."""
        meta = self.entries.agg(F.count(F.lit(1)).alias("n_entries"), F.sum(record_size("name")).alias("metadata_bytes"), F.sum("size").alias("plain_bytes"))
        data = self.blocks.agg(F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.sum("length"), F.lit(0)).alias("data_bytes"))
        return meta.crossJoin(data)  # one row each


def build(files: DataFrame, codec: str = "zlib", block: int = 4096) -> Container:
    """The container of ``files`` (name string, content string or binary). Names may repeat."""
    rows = files.select("name", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content")).withColumn("size", size_of("content")).withColumn("digest", F.sha2("content", 256))
    records = pointers(rows.select("name", "size", "digest", record_size("name").alias("record")), ["name", "digest"], "record", SUPERBLOCK).withColumnRenamed("ptr", "entry_offset")
    records = spool(records, "records")
    first = spool(records.where("size > 0").groupBy("digest").agg(F.min("name").alias("leader")), "leaders")
    led = first.select(F.col("leader").alias("__leader"), F.col("digest").alias("__digest"))
    stored = rows.join(led, (F.col("name") == F.col("__leader")) & (F.col("digest") == F.col("__digest"))).dropDuplicates(["digest"]).select("digest", F.col("__leader").alias("leader"), "content", "size")
    plain = F.expr("substring(content, int(blk_offset) + 1, int(blk_length))")
    cut = blocks(stored, block).select("digest", "leader", "blk_nr", "blk_length", F.crc32(plain).alias("crc"), encoded(plain, codec).alias("payload"))
    cut = spool(cut, "blocks").withColumn("length", size_of("payload"))
    placed = spool(pointers(cut, ["leader", "digest", "blk_nr"], "length"), "placed")
    starts = placed.where("blk_nr = 0").select(F.col("digest").alias("__d"), "leader", F.col("ptr").alias("data_offset"))
    entries = records.join(starts, F.col("digest") == F.col("__d"), "left").select("name", "size", "digest", "entry_offset", "leader", "data_offset")
    return Container(spool(entries, "entries"), placed, codec, block)


def totals_problem(held: Container, stored: DataFrame) -> DataFrame:
    """field, counted, told: where the totals that were stored (one row of ``totals``) are not those that are counted."""
    fields = ("n_entries", "metadata_bytes", "plain_bytes", "n_blocks", "data_bytes")
    told = stored.select(*(F.col(c).alias(f"told_{c}") for c in fields))
    both = held.totals().crossJoin(told)  # one row each
    each = both.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("bigint").alias("counted"), F.col(f"told_{c}").cast("bigint").alias("told")) for c in fields))))
    return each.where("not (counted <=> told)")


def plain_blocks(held: Container) -> DataFrame:
    """digest, blk_nr, blk_offset, blk_length, crc, plain of each block; plain is null where it does not decode."""
    plain = decoded(F.col("payload"), F.col("blk_length"), held.codec).alias("plain")
    return held.blocks.select("digest", "blk_nr", (F.col("blk_nr") * held.block).alias("blk_offset"), "blk_length", "crc", plain)


def read(held: Container) -> DataFrame:
    """name, content of every file; empty files have no blocks. A whole file is one row here;
    ``plain_blocks`` and ``extract`` keep to blocks."""
    joined = plain_blocks(held).groupBy(F.col("digest").alias("__d")).agg(F.expr("listagg(plain) WITHIN GROUP (ORDER BY blk_nr)").alias("content"))
    return held.entries.join(joined, F.col("digest") == F.col("__d"), "left").select("name", F.coalesce("content", F.lit(b"")).alias("content"))


def decode_totals(held: Container) -> DataFrame:
    """digest, n_blocks, raw_bytes, plain_bytes, least, most (encoded lengths), n_bad (blocks that do not
    decode to their length and checksum) of each stored content, block by block."""
    sound = F.col("plain").isNotNull() & (F.crc32(F.coalesce("plain", F.lit(b""))) == F.col("crc"))
    plain = decoded(F.col("payload"), F.col("blk_length"), held.codec).alias("plain")
    each = held.blocks.select("digest", "blk_length", "length", "crc", plain)
    return each.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum("length").alias("raw_bytes"),
        F.sum(F.octet_length("plain")).cast("bigint").alias("plain_bytes"),
        F.min("length").alias("least"),
        F.max("length").alias("most"),
        F.sum((~sound).cast("bigint")).alias("n_bad"),
    )


def violations(held: Container) -> DataFrame:
    """check, name, detail of everything that does not hold; empty for a sound container.

    Blocks are decoded and checked one by one; whole files never meet.
    """
    got = decode_totals(held).select(F.col("digest").alias("__d"), "n_blocks", "plain_bytes", "most", "n_bad")
    files = held.entries.join(got, F.col("digest") == F.col("__d"), "left")
    tests = {
        "name": F.octet_length("name") > 255,
        "zero_name": F.octet_length("name") == 0,
        "nul_in_name": F.instr("name", "\0") > 0,
        "decode": F.coalesce("n_bad", F.lit(0)) > 0,
        "size": F.coalesce("plain_bytes", F.lit(0)) != F.col("size"),
        "bound": F.coalesce(F.col("most") > worst_case(held.codec, F.lit(held.block).cast("bigint")), F.lit(False)),
        "offset": (F.col("size") > 0) & (F.col("data_offset").isNull() | (F.col("data_offset") < 0)),
    }
    rows = F.explode(F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull()))
    by_file = files.select(rows.alias("check"), "name", F.concat_ws(" ", F.lit("entry at"), F.col("entry_offset")).alias("detail"))
    empty = held.blocks.where("length = 0").select(F.lit("empty_block").alias("check"), F.col("leader").alias("name"), F.col("blk_nr").cast("string").alias("detail"))
    return by_file.unionByName(empty)


def compression(held: Container) -> DataFrame:
    """name, size, raw_bytes, change (percent) of every file that has content."""
    raw = held.blocks.groupBy(F.col("digest").alias("__d")).agg(F.sum("length").alias("raw_bytes"))
    return held.entries.join(raw, F.col("digest") == F.col("__d")).select("name", "size", "raw_bytes", ratio_change(F.col("raw_bytes"), F.col("size")).alias("change"))
