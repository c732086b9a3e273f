"""Finding the keys (anchors, shingles, windows) that several texts share.

Each task gathers the keys of some thousand texts and packs them, by key range, into a
few binary rows, which costs a fraction of one row per key in the shuffle. A key that
many texts of a task hold is settled there: they know already that it is shared, and one
entry stands for all of them in the shuffle, so that no key, however common, brings more
than a few entries per task to the group that it falls into. The groups are key ranges
of about ``PER_RANGE`` entries.

Texts are told apart by an identity, a whole number; texts with one identity count once.
So an identity must stand for one content (such as its hash). Where the order of texts
matters ("low"), each has a rank besides, which several identities may share: a key is low
for those with a rank above its least one, and comes back with the identity of a text of
lower rank that has it. Of the least rank in a task all entries are sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import give_back

#: Keys per packed batch of a task, and about how many entries one key range has.
PER_FLUSH = 1 << 19
PER_RANGE = 1 << 20
#: An identity for entries that stand for many texts.
MANY = np.iinfo(np.int64).min

PACKED = "part int, kind int, keys binary, ids binary, ranks binary, sizes binary, counts binary, dfs binary"
PACKED_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32())] + [(n, pa.binary()) for n in ("keys", "ids", "ranks", "sizes", "counts", "dfs")])
SHARED = "identity bigint, size int, keys binary, dfs binary, holders binary"
SHARED_ARROW = pa.schema([("identity", pa.int64()), ("size", pa.int32()), ("keys", pa.binary()), ("dfs", pa.binary()), ("holders", pa.binary())])
ENTRIES, MARKS, SETTLED = 0, 1, 2

#: identity, size, keys; in "low" mode also the rank, where it is not the identity.
Text = tuple[int, int, np.ndarray] | tuple[int, int, np.ndarray, int]


def ranges_for(keys: int) -> int:
    """Bits of the key range number, for so many keys: 64 ranges at least, so that small inputs spread too."""
    return max(6, min(24, (max(1, keys) // PER_RANGE).bit_length()))


def batch(arrays: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, schema.types, strict=True)], schema=schema)


def by_identity(ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, dfs: np.ndarray, holders: np.ndarray) -> Iterator[tuple]:
    """(identity, size, keys, dfs, holders) with the keys of one identity together."""
    order = np.argsort(ids, kind="stable")
    ids, sizes, keys, dfs, holders = ids[order], sizes[order], keys[order], dfs[order], holders[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    ends = [*starts[1:].tolist(), len(ids)]
    raw, freq, held = keys.astype("<u8").tobytes(), dfs.astype(np.uint8).tobytes(), holders.astype("<i8").tobytes()
    for s, e in zip(starts.tolist(), ends, strict=bool(len(starts))):
        yield int(ids[s]), int(sizes[s]), raw[8 * s : 8 * e], freq[s:e], held[8 * s : 8 * e]


class Packing:
    """``mode``: "shared" finds keys of two identities or more; "low" those that a smaller
    rank has too; "df" also tells in how many identities a key is, up to ``cap``."""

    def __init__(self, mode: str, bits: int, key_bytes: int, cap: int = 32) -> None:
        key_bytes = key_bytes if bits + 8 * key_bytes <= 64 else 8
        self.mode, self.bits, self.key_bytes, self.cap = mode, bits, key_bytes, cap
        self.shift = max(0, 64 - bits - 8 * key_bytes)
        self.local = cap if mode == "df" else 2

    def canonical(self, keys: np.ndarray) -> np.ndarray:
        """Keys as they come back: cut to the bits that are compared."""
        return keys >> np.uint64(self.shift)

    def part_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits - self.shift)).astype(np.int64)

    def _narrow(self, keys: np.ndarray) -> bytes:
        return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.key_bytes].tobytes()

    def _widen(self, raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // self.key_bytes, 8), np.uint8)
        out[:, : self.key_bytes] = np.frombuffer(raw, np.uint8).reshape(-1, self.key_bytes)
        return out.view("<u8").ravel()

    def pack(self, texts: Iterable[Text]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, int]] = {}
        total = 0
        for identity, size, keys, *rank in texts:
            if identity not in held:
                held[identity] = size, keys, rank[0] if rank else identity
                total += len(keys)
            if total >= PER_FLUSH:
                yield from self._flush(held)
                held, total = {}, 0
        if total:
            yield from self._flush(held)
        held = {}
        give_back()

    def _flush(self, held: dict[int, tuple[int, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        names = np.array(sorted(held, key=lambda i: (held[i][2], i)), np.int64)  # ascending, so the first text of a key has the smallest rank
        ranks = np.array([held[i][2] for i in names.tolist()], np.int64)
        sizes = np.array([held[i][0] for i in names.tolist()], np.int32)
        lengths = [len(held[i][1]) for i in names.tolist()]
        keys = self.canonical(np.concatenate([held[i][1] for i in names.tolist()]))
        text = np.repeat(np.arange(len(names)), lengths)
        order = np.argsort(keys, kind="stable")
        keys, text = keys[order], text[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(keys)))
        many = np.repeat(counts >= self.local, counts)
        least = ranks[text] == np.repeat(ranks[text[starts]], counts) if self.mode == "low" else first
        settled = many & ~least if self.mode == "low" else many
        sent = ~many if self.mode == "df" else ~many | least
        rows: list[list] = []
        parts = self.part_of(keys)
        if settled.any():
            spread = int(names[0]) % (1 << self.bits)
            dfs = np.full(int(settled.sum()), self.cap)
            ids, spans, raw, freq, size, lower = [], [], [], [], [], []
            first_of = names[np.repeat(text[starts], counts)][settled] if self.mode == "low" else dfs[:0]
            for i, n, k, f, h in by_identity(names[text[settled]], sizes[text[settled]], keys[settled], dfs, first_of if self.mode == "low" else np.zeros(len(dfs), np.int64)):
                ids.append(i), size.append(n), spans.append(len(f)), raw.append(k), freq.append(f), lower.append(h)
            rows.append([spread, SETTLED, b"".join(raw), np.array(ids, "<i8").tobytes(), b"".join(lower) if self.mode == "low" else b"", np.array(size, "<i4").tobytes(), np.array(spans, "<u4").tobytes(), b"".join(freq)])
        if self.mode == "df" and many.any():
            marked, of = keys[many & first], parts[many & first]
            for p in np.unique(of).tolist():
                rows.append([p, MARKS, self._narrow(marked[of == p]), b"", b"", b"", b"", b""])
        keys, text, parts = keys[sent], text[sent], parts[sent]
        # Keys are sorted, so parts are runs; within a part, entries go by text.
        edges = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else np.zeros(0, np.int64)
        for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(parts)], strict=bool(len(edges))):
            turn = np.argsort(text[s:e], kind="stable")
            who, times = np.unique(text[s:e], return_counts=True)
            rows.append([int(parts[s]), ENTRIES, self._narrow(keys[s:e][turn]), names[who].astype("<i8").tobytes(), ranks[who].astype("<i8").tobytes() if self.mode == "low" else b"", sizes[who].astype("<i4").tobytes(), times.astype("<u4").tobytes(), b""])
        step = max(1, len(rows) // 8)
        for s in range(0, len(rows), step):
            yield batch(list(zip(*rows[s : s + step], strict=True)), PACKED_ARROW)

    def merge(self, table: pa.Table) -> pa.Table:
        """All packed rows of one key range: the shared keys of each identity."""
        out: list[tuple] = []
        keys, ids, ranks, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        part = table.column("part")[0].as_py()
        columns = [table.column(n).to_pylist() for n in PACKED_ARROW.names[1:]]
        for kind, raw, who, rank, size, count, dfs in zip(*columns, strict=True):
            if kind == SETTLED:
                at = 0
                for i, n, c in zip(np.frombuffer(who, "<i8").tolist(), np.frombuffer(size, "<i4").tolist(), np.frombuffer(count, "<u4").tolist(), strict=True):
                    out.append((i, n, raw[8 * at : 8 * (at + c)], dfs[at : at + c], rank[8 * at : 8 * (at + c)]))
                    at += c
                continue
            keys.append(self._widen(raw))
            times = np.frombuffer(count, "<u4") if kind == ENTRIES else 1
            ids.append(np.repeat(np.frombuffer(who, "<i8"), times) if kind == ENTRIES else np.full(len(keys[-1]), MANY))
            if self.mode == "low":
                ranks.append(np.repeat(np.frombuffer(rank, "<i8"), times))
            sizes.append(np.repeat(np.frombuffer(size, "<i4"), times) if kind == ENTRIES else np.zeros(len(keys[-1]), np.int32))
        k, i, n = np.concatenate(keys), np.concatenate(ids), np.concatenate(sizes)
        r = np.concatenate(ranks) if self.mode == "low" else i
        order = np.argsort(k, kind="stable")
        k = k[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(k)))
        again = np.repeat(counts > 1, counts)
        k, i, n, r = k[again], i[order][again], n[order][again], r[order][again]
        order = np.lexsort((i, r, k) if self.mode == "low" else (i, k))
        k, i, n, r = k[order], i[order], n[order], r[order]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (i[1:] == MANY)]) if len(k) else np.zeros(0, bool)
        k, i, n, r = k[fresh], i[fresh], n[fresh], r[fresh]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(k)))
        df = np.add.reduceat(np.where(i == MANY, self.cap, 1), starts) if len(k) else counts
        keep = np.repeat(df > 1, counts) & (i != MANY)
        if self.mode == "low":
            keep &= np.repeat(r[starts], counts) < r if len(k) else keep
        df = np.minimum(np.repeat(df, counts), self.cap)
        full = k | (np.uint64(part) << np.uint64(8 * self.key_bytes)) if self.key_bytes < 8 else k
        lower = np.repeat(i[starts], counts) if len(k) else i
        out += ((*row[:4], row[4] if self.mode == "low" else b"") for row in by_identity(i[keep], n[keep], full[keep], df[keep], lower[keep]))
        return pa.Table.from_batches([batch(list(zip(*out, strict=True)) or [[]] * 5, SHARED_ARROW)])


def shared(rows: DataFrame, texts: Callable[[Iterator[pa.RecordBatch]], Iterable[Text]], packing: Packing) -> DataFrame:
    """identity, size, keys, dfs, holders ("low" only): the shared keys of each identity, in several rows.

    ``texts`` turns the batches of ``rows`` into (identity, size, distinct 64-bit keys). A
    key may come twice for one identity.
    """

    def pack(batches):
        yield from packing.pack(texts(batches))

    def merge(table: pa.Table) -> pa.Table:
        return packing.merge(table)

    return rows.mapInArrow(pack, PACKED).groupBy("part").applyInArrow(merge, SHARED)


def gathered(found: DataFrame) -> DataFrame:
    """identity, size and lists of keys, dfs and holders; one row per identity, as large as its text at most."""
    return found.groupBy("identity", "size").agg(F.collect_list(F.struct("keys", "dfs", "holders")).alias("lists"))


def keys_of(lists: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and the largest df told for each."""
    keys = np.frombuffer(b"".join(x["keys"] for x in lists), "<u8")
    dfs = np.frombuffer(b"".join(x["dfs"] for x in lists), np.uint8)
    order = np.lexsort((-dfs.astype(np.int16), keys))
    keys, dfs = keys[order], dfs[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return keys[first], dfs[first]


def holders_of(lists: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and a holder for each."""
    keys = np.frombuffer(b"".join(x["keys"] for x in lists), "<u8")
    holders = np.frombuffer(b"".join(x["holders"] for x in lists), "<i8")
    keys, first = np.unique(keys, return_index=True)
    return keys, holders[first]
