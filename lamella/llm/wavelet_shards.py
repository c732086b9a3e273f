"""Token shards as wavelet matrices: one compressed file per shard, in doc_id order.

A wavelet matrix holds the ids of a shard as bit-planes, highest bit first; after each
plane the ids are dealt stably into those with a 0 and those with a 1. With the number
of ones before each 512th bit, the file answers access (the id at a place), rank
(occurrences before a place), count, select (the k-th occurrence) and locate (all
occurrences) without being unpacked into ids.

Documents are dealt to tasks by ranges of doc_id, so shards follow each other in that
order; each task cuts its range into shards of about ``shard_tokens`` ids and each shard
is one row of a Parquet file in the output folder, written by Spark's own committer.

Special rows: a null or empty text has the end id only; rows with a null doc_id come
first (the least bigint stands for none, so a doc_id of -2^63 comes back as null); repeated rows are all kept, side by side; extra columns are ignored. An empty
table gives an empty folder and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import out_batches, rows_of, whole_text
from lamella.llm.tokenise import encoder
from lamella.plans.numbering import ordered_total
from lamella.plans.spool import spool_path

END = 2
SHARD_TOKENS = 1 << 20
BLOCK = 512
HEADER = struct.Struct("<4sIQI")
MAGIC = b"WMX1"
NO_ID = np.iinfo(np.int64).min

SHARDS = "shard bigint, n_docs bigint, n_tokens bigint, payload binary"
SHARDS_ARROW = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
READ = "shard bigint, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"
READ_ARROW = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def build(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray) -> bytes:
    """The file of one shard."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    levels = max(1, int(ids.max(initial=0)).bit_length())
    x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    parts = [doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes()]
    for level in range(levels - 1, -1, -1):
        ones = (x & (1 << level)) != 0
        packed = np.packbits(ones, bitorder="little")
        blocks = np.add.reduceat(ones, np.arange(0, len(x), BLOCK), dtype=np.uint32) if len(x) else np.zeros(0, np.uint32)
        parts += [packed.tobytes(), (np.cumsum(blocks) - blocks).astype("<u4").tobytes()]
        x = np.concatenate([x.take(np.flatnonzero(~ones)), x.take(np.flatnonzero(ones))])
    body = [squeeze(p) for p in parts]
    sizes = struct.pack(f"<{len(body)}I", *map(len, body))
    return HEADER.pack(MAGIC, len(doc_ids), len(ids), levels) + sizes + b"".join(body)


class WaveletFile:
    """Reads one shard's file. All planes are expanded to their packed bits (a few MB for a shard);
    single bits are only unpacked where a query looks."""

    def __init__(self, payload: bytes) -> None:
        import zstandard

        magic, self.n_docs, self.n, self.levels = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        count = 2 + 2 * self.levels
        sizes = struct.unpack_from(f"<{count}I", payload, HEADER.size)
        at, expand, parts = HEADER.size + 4 * count, zstandard.ZstdDecompressor().decompress, []
        for size in sizes:
            parts.append(expand(payload[at : at + size]))
            at += size
        self.doc_ids = np.frombuffer(parts[0], "<i8")
        self.lengths = np.frombuffer(parts[1], "<u8").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.planes = [np.frombuffer(p, np.uint8) for p in parts[2::2]]
        self.before = [np.frombuffer(p, "<u4") for p in parts[3::2]]
        self.zeros = [self.n - self._ones(k, self.n) for k in range(self.levels)]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i == 0:
            return 0
        block = (i - 1) // BLOCK
        lo = block * BLOCK // 8
        bits = np.unpackbits(self.planes[plane][lo : (i + 7) // 8], bitorder="little", count=i - block * BLOCK)
        return int(self.before[plane][block]) + int(bits.sum())

    def access(self, i: int) -> int:
        """The id at place i."""
        out = 0
        for k in range(self.levels):
            bit = int(self.planes[k][i >> 3]) >> (i & 7) & 1
            out = out << 1 | bit
            i = self.zeros[k] + self._ones(k, i) if bit else i - self._ones(k, i)
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences among the first i ids stand below the last plane."""
        lo, hi = 0, i
        if token >> self.levels:
            return 0, 0
        for k in range(self.levels):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.levels - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token among the first i ids."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        return int(self._up(token, np.array([lo + k]))[0])

    def locate(self, token: int) -> np.ndarray:
        """All places of the token, ascending."""
        return self._up(token, np.arange(*self._range(token, self.n)))

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - k) & 1
            wanted = at - self.zeros[k] * bit
            ones = self.before[k].astype(np.int64)
            sums = ones if bit else np.arange(len(ones)) * BLOCK - ones
            blocks = np.searchsorted(sums, wanted, side="right") - 1
            at = np.empty_like(wanted)
            for j, (w, b) in enumerate(zip(wanted.tolist(), blocks.tolist(), strict=True)):
                bits = np.unpackbits(self.planes[k][b * BLOCK // 8 : (b + 1) * BLOCK // 8], bitorder="little", count=min(BLOCK, self.n - b * BLOCK))
                at[j] = b * BLOCK + np.flatnonzero(bits == bit)[w - sums[b]]
        return at

    def ids(self) -> np.ndarray:
        """All ids of the shard, from the bit-planes, last plane first."""
        x = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], bitorder="little", count=self.n).view(bool)
            up, zeros = np.empty_like(x), self.zeros[k]
            up[np.flatnonzero(~ones)] = x[:zeros]
            up[np.flatnonzero(ones)] = x[zeros:] | np.array(1 << (self.levels - 1 - k), x.dtype)
            x = up
        return x


def write(docs: DataFrame, vocabulary: str, path: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode the documents and write their shards, in ascending doc_id order."""
    end_id = np.array([end], dtype="<u4").tobytes()

    def encode(batches):
        coder = encoder(vocabulary, False)
        first = TaskContext.get().partitionId() << 32

        def rows() -> Iterator[tuple]:
            shard, held, keys, n = first, [], [], 0
            for doc_id, ids in coder.encode_all(rows_of(batches, "doc_id", "text")):
                ids += end_id
                if held and n + len(ids) // 4 > shard_tokens:
                    yield flushed(shard, held, keys)
                    shard, held, keys, n = shard + 1, [], [], 0
                held.append(ids)
                keys.append(NO_ID if doc_id is None else doc_id)
                n += len(ids) // 4
            if held:
                yield flushed(shard, held, keys)

        def flushed(shard: int, held: list[bytes], keys: list[int]) -> tuple:
            ids = np.frombuffer(b"".join(held), "<u4")
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            return shard, len(keys), len(ids), build(ids, lengths, np.array(keys, np.int64))

        yield from out_batches(rows(), SHARDS_ARROW, size=8)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "text").mapInArrow(encode, SHARDS).write.option("compression", "uncompressed").option("parquet.block.size", str(32 << 20)).parquet(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""

    def decode(batches):
        def rows() -> Iterator[tuple]:
            for shard, payload in rows_of(batches, "shard", "payload"):
                file = WaveletFile(payload)
                raw = file.ids().astype("<u4").tobytes()
                for doc_id, start, n in zip(file.doc_ids.tolist(), file.starts.tolist(), file.lengths.tolist(), strict=True):
                    yield shard, None if doc_id == NO_ID else doc_id, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])

        yield from out_batches(rows(), READ_ARROW)

    shards = files(spark, path)
    docs = shards.select("shard", "payload").mapInArrow(decode, READ)
    base = ordered_total(shards.select(F.col("shard").alias("__shard"), "n_tokens"), ["__shard"], F.col("n_tokens"), "__ahead").drop("n_tokens")
    return docs.join(base, docs["shard"] == base["__shard"]).select("doc_id", (F.col("__ahead") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, n: occurrences of each token, by rank queries on the files."""
    wanted = sorted(set(tokens))
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(batches):
        yield from out_batches(((t, file.count(t)) for (payload,) in rows_of(batches, "payload") for file in [WaveletFile(payload)] for t in wanted), schema)

    return files(spark, path).select("payload").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, place: where the token stands, by select queries on the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64())])

    def locate(batches):
        def rows() -> Iterator[tuple]:
            for (payload,) in rows_of(batches, "payload"):
                file = WaveletFile(payload)
                at = file.locate(token)
                docs = np.searchsorted(file.starts, at, side="right") - 1
                yield from zip(file.doc_ids[docs].tolist(), (at - file.starts[docs]).tolist(), strict=True)

        yield from out_batches(rows(), schema)

    return files(spark, path).select("payload").mapInArrow(locate, "doc_id bigint, place bigint")


def stored(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the documents' shards and read them back."""
    path = spool_path(docs.sparkSession, "wavelet")
    write(docs, vocabulary, path)
    return read(docs.sparkSession, path)
