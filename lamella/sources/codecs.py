"""Block codecs as Arrow functions, and their capability table."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.scalars import little_endian

#: Flag bit, name, smallest block (0: a memory page), codec data bytes, streamed, available here.
CODECS = [
    (0x100, "zlib", 512, 0, True, True),
    (0x200, "lz4", 0, 0, False, True),
    (0x400, "lzo", 0, 0, False, False),
    (0x800, "xz", 4096, 8, True, True),
    (0x1000, "zstd", 0, 0, True, True),
]
LEAST_SHIFT, MOST_SHIFT, PAGE = 9, 20, 4096
XZ_MEMORY = 64 << 20
#: Fixed value: the number that xz's codec data begin with.
XZ_MAGIC = 0x377A585A
#: Branch filters that xz can put before its compression.
BCJ = {"x86": lzma.FILTER_X86, "powerpc": lzma.FILTER_POWERPC, "ia64": lzma.FILTER_IA64, "arm": lzma.FILTER_ARM, "armthumb": lzma.FILTER_ARMTHUMB, "sparc": lzma.FILTER_SPARC}


def codec_table(spark: SparkSession) -> DataFrame:
    rows = [(i, n, low, 1 << MOST_SHIFT, dd, s, c) for i, n, low, dd, s, c in CODECS]
    return spark.createDataFrame(rows, "id int, name string, min_blksz bigint, max_blksz bigint, dd_sz int, streamed boolean, compiled boolean")


def block_sizes(codecs: DataFrame, page: int = PAGE) -> DataFrame:
    """name, blksz: the powers of two that each codec takes."""
    sizes = F.explode(F.transform(F.sequence(F.lit(LEAST_SHIFT), F.lit(MOST_SHIFT)), lambda s: F.expr("1L") * F.pow(F.lit(2), s).cast("bigint")))
    low = F.when(F.col("min_blksz") == 0, page).otherwise(F.col("min_blksz"))
    return codecs.select("name", "compiled", low.alias("low"), "max_blksz", sizes.alias("blksz")).where("blksz between low and max_blksz").select("name", "compiled", "blksz")


def usable(codecs: DataFrame, wanted: DataFrame, page: int = PAGE) -> DataFrame:
    """``wanted`` (name, blksz) with the codec's id and problem: unknown, not available, or a block size
    that it does not take (one without a least size takes a page at least)."""
    known = codecs.select(F.col("name").alias("__name"), "id", "compiled", F.when(F.col("min_blksz") == 0, page).otherwise(F.col("min_blksz")).alias("__low"), F.col("max_blksz").alias("__high"))
    joined = wanted.join(F.broadcast(known), F.col("name") == F.col("__name"), "left")  # one row per codec
    problem = F.when(F.col("__name").isNull(), "unknown").when(~F.col("compiled"), "not available").when((F.col("blksz") < F.col("__low")) | (F.col("blksz") > F.col("__high")), "block size")
    return joined.select(*wanted.columns, "id", problem.alias("problem"))


def first_available(codecs: DataFrame) -> DataFrame:
    """The codec with the least id among those that are available."""
    return codecs.where("compiled").orderBy("id").limit(1)


def xz_data_problem(data: Column, least: int = 4096) -> Column:
    """What is wrong with xz's codec data (8 bytes: a magic number and the dictionary size); null if nothing is."""
    size = little_endian(data, 5, 4)
    return F.when(F.octet_length(data) != 8, "length").when(little_endian(data, 1, 4) != XZ_MAGIC, "magic").when(size < least, "dictionary")


def _encoder(name: str, level: int | None) -> Callable[[bytes], bytes]:
    if name == "zlib":
        return lambda raw: zlib.compress(raw, -1 if level is None else level)
    if name == "lz4":
        codec = pa.Codec("lz4_raw")
        return lambda raw: codec.compress(raw, asbytes=True)
    if name == "xz":
        return lambda raw: lzma.compress(raw, format=lzma.FORMAT_XZ, check=lzma.CHECK_CRC32, preset=level)
    if name.startswith("xz+"):
        chain = [{"id": BCJ[name[3:]]}, {"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT if level is None else level}]
        return lambda raw: lzma.compress(raw, format=lzma.FORMAT_XZ, check=lzma.CHECK_CRC32, filters=chain)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=15 if level is None else level).compress
    raise ValueError(f"codec {name} is not available")


def _decoder(name: str) -> Callable[[bytes, int], bytes]:
    if name == "zlib":
        return lambda raw, n: zlib.decompress(raw)
    if name == "lz4":
        codec = pa.Codec("lz4_raw")
        return lambda raw, n: codec.decompress(raw, decompressed_size=n, asbytes=True)
    if name == "xz" or name.startswith("xz+"):
        return lambda raw, n: lzma.LZMADecompressor(memlimit=XZ_MEMORY).decompress(raw)
    if name == "zstd":
        import zstandard

        return lambda raw, n: zstandard.ZstdDecompressor().decompress(raw, max_output_size=n)
    raise ValueError(f"codec {name} is not available")


def encoded(payload: Column, name: str, level: int | None = None) -> Column:
    """The payload's blocks, encoded one by one; a block that grows stays grown.

    "xz+x86" and the like put a filter of ``BCJ`` before xz.
    """

    def encode(blocks: pa.Array) -> pa.Array:
        one = _encoder(name, level)
        return pa.array([None if b is None else one(b) for b in blocks.to_pylist()], pa.binary())

    return F.arrow_udf(encode, "binary")(payload)


def candidates(blocks: DataFrame, key: str, payload: str, choices: list[tuple[str, int | None]]) -> DataFrame:
    """key, codec, ord, len: the real length of each block under each (codec, level)."""
    tried = [F.struct(F.lit(name).alias("codec"), F.lit(i).alias("ord"), F.octet_length(encoded(F.col(payload), name, level)).cast("bigint").alias("len")) for i, (name, level) in enumerate(choices)]
    return blocks.select(key, F.inline(F.array(*tried)))


def decoded(payload: Column, size: Column, name: str) -> Column:
    """Blocks decoded to ``size`` bytes each; null where a block does not decode to that."""

    def decode(blocks: pa.Array, sizes: pa.Array) -> pa.Array:
        one, out = _decoder(name), []
        for b, n in zip(blocks.to_pylist(), sizes.to_pylist(), strict=True):
            try:
                raw = None if b is None else one(b, n)
            except Exception:  # each library has its own error types: a broken block is a null here
                raw = None
            out.append(raw if raw is not None and len(raw) == n else None)
        return pa.array(out, pa.binary())

    return F.arrow_udf(decode, "binary")(payload, size)
