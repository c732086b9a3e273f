"""Screens for set similarity: which documents share enough of their sets, and what they share.

The sets are ordered by hash value. In a partial screen, a document with n shingles that must
have o of them in common with any partner sends its first n - o + e shingles only, e being an
eighth of n: a partner shares at least o / 8 of what both send (at least the smaller of the
two e, and a partner has o shingles or more). So documents of whose sent shingles fewer
are held by others have no partner, and three eighths of the shingles decide that. In a
whole screen, a document sends all its shingles and shares at least o of them.

A sent shingle is a key of 32 bits within its key range and six bytes of its owner, about
ten bytes whatever the number of ranges. Keys are sorted within a task and packed by range,
so the shuffle carries a row per task and range instead of one per shingle. A key that
``CAP`` texts of a flush hold is settled there: they know that it is common, and one mark
stands for all of them in the shuffle, so no key, however common, brings more than ``CAP``
entries per flush of a task to the group that it falls into. Keys or owners that fall
together only make keys look shared, which costs a verification; the keys of one document
that fall together are counted (``lost``) and taken off the number that it must share.

The numbers that describe each document travel in the same shuffle, so texts are read once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import give_back, rows_of, whole_text
from lamella.llm.words import mixed
from lamella.plans.spool import spool

#: Keys and documents per packed batch of a task, and about how many entries one key range has.
PER_FLUSH = 1 << 19
DOCS_PER_FLUSH = 1 << 13
PER_RANGE = 1 << 20
#: Bytes of text per sent shingle, about; it only sets the number of key ranges.
TEXT_BYTES = 20
#: Frequencies are told apart up to this one.
CAP = 32
#: An owner is six bytes of an identity; all bits set stand for ``CAP`` owners.
OWNER_BYTES = 6
OWNER_MASK = (1 << 8 * OWNER_BYTES) - 1
FACTS, ENTRIES, SETTLED = 0, 1, 2

#: Two hashes of the text as it stands, 128 bits; they tell the texts of one doc_id apart.
MARKS = {"mark": lambda: F.xxhash64(whole_text()), "mark2": lambda: F.xxhash64(F.lit(1), whole_text())}
FACT_FIELDS = [("doc_id", pa.int64()), ("mark", pa.int64()), ("mark2", pa.int64()), ("n_shingles", pa.int64()), ("lost", pa.int64()), ("identity", pa.int64())]
PACKED_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *FACT_FIELDS, ("keys", pa.binary()), ("owners", pa.binary())])
PACKED = "part int, kind int, doc_id bigint, mark bigint, mark2 bigint, n_shingles bigint, lost bigint, identity bigint, keys binary, owners binary"
SCREEN_ARROW = pa.schema([*FACT_FIELDS, ("owner", pa.int64()), ("hits", pa.int64()), ("keys", pa.binary()), ("dfs", pa.binary())])
SCREEN = "doc_id bigint, mark bigint, mark2 bigint, n_shingles bigint, lost bigint, identity bigint, owner bigint, hits bigint, keys binary, dfs binary"


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, mark, mark2 of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), *(hashed().alias(c) for c, hashed in MARKS.items()))


def cells(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary array whose k-th value is data[edges[k]:edges[k + 1]]."""
    raw = np.ascontiguousarray(data)
    width = raw.nbytes // max(1, len(raw))
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the length of ``x`` at the end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def filled(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """``n`` rows with these columns, null in the others."""
    held = {k: x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()}
    return pa.RecordBatch.from_arrays([held.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


#: A document's numbers (FACT_FIELDS; None for rows without), its identity (None for an empty set) and its shingles.
Row = tuple[tuple | None, int | None, np.ndarray]


class Screen:
    """Packs the sent shingles of a task's documents, and merges those of a key range.

    ``part``: the sent shingles beyond n - o are this part of n; None sends all of them.
    """

    def __init__(self, bits: int, percent: int, part: int | None = 8, cap: int = CAP, per_flush: int = PER_FLUSH) -> None:
        self.bits, self.percent, self.part, self.cap, self.per_flush = bits, percent, part, cap, per_flush

    def least(self, n: int) -> int:
        """Shingles that a document with n has in common with any partner, at least."""
        return -(-n * self.percent // 100)

    def sent(self, shingles: np.ndarray) -> np.ndarray:
        """What a document sends of its ascending shingles."""
        n = len(shingles)
        return shingles[: n - self.least(n) + max(1, n // self.part)] if self.part and n else shingles

    def common_column(self, n: Column) -> Column:
        """How many of its sent shingles any partner has sent too, at least."""
        least = F.call_function("div", n * self.percent + 99, F.lit(100).cast("bigint"))
        return F.greatest(F.lit(1), F.call_function("div", least, F.lit(self.part).cast("bigint")) if self.part else least)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """The keys of sent shingles. They are mixed anew, since the sent ones have small hashes."""
        return mixed(shingles) >> np.uint64(32 - self.bits)

    def lost(self, shingles: np.ndarray) -> int:
        """How many sent shingles share their key with another one of the document."""
        sent = self.sent(shingles)
        return len(sent) - len(np.unique(self.keys(sent)))

    def pack(self, rows: Iterable[Row]) -> Iterator[pa.RecordBatch]:
        facts: list[tuple] = []
        held: dict[int, np.ndarray] = {}
        total = 0
        for fact, who, shingles in rows:
            if fact is not None:
                facts.append(fact)
            if who is not None and who not in held:
                held[who] = self.sent(shingles).copy()
                total += len(held[who])
            if total >= self.per_flush or len(facts) >= DOCS_PER_FLUSH:
                yield from self._flush(facts, held)
                facts, held, total = [], {}, 0
        yield from self._flush(facts, held)
        facts, held = [], {}
        give_back()

    def _flush(self, facts: list[tuple], held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if facts:
            columns = dict(zip((f for f, _ in FACT_FIELDS), zip(*facts, strict=True), strict=True))
            parts = np.array([x or 0 for x in columns["mark"]], np.int64) & ((1 << self.bits) - 1)
            yield filled(PACKED_ARROW, len(facts), part=parts, kind=np.full(len(facts), FACTS), **columns)
        if not held:
            return
        owners = np.array(list(held), np.int64).astype(np.uint64) & np.uint64(OWNER_MASK)
        keys = self.keys(np.concatenate(list(held.values())))
        who = np.repeat(np.arange(len(owners)), [len(x) for x in held.values()])
        order = np.argsort(keys)
        keys, who = keys[order], who[order]
        edges = runs(keys)
        counts = np.diff(edges)
        many = np.repeat(counts >= self.cap, counts)
        if many.any():
            turn = np.argsort(who[many], kind="stable")
            settled, of = keys[many][turn], owners[who[many][turn]]
            yield filled(PACKED_ARROW, 1, part=[int(owners[0]) & ((1 << self.bits) - 1)], kind=[SETTLED], keys=[settled.astype("<u8").tobytes()], owners=[of.astype("<u8").tobytes()])
        marks = keys[edges[:-1][counts >= self.cap]]
        keys = np.concatenate([keys[~many], marks])
        of = np.concatenate([owners[who[~many]], np.full(len(marks), OWNER_MASK, np.uint64)])
        order = np.argsort(keys)
        keys, of = keys[order], of[order]
        part = (keys >> np.uint64(32)).astype(np.int32)
        edges = runs(part)
        low = cells(keys.astype("<u4"), edges)
        six = cells(of.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :OWNER_BYTES], edges)
        yield filled(PACKED_ARROW, len(low), part=part[edges[:-1]], kind=np.full(len(low), ENTRIES), keys=low, owners=six)

    def merge(self, table: pa.Table, whole: bool) -> pa.Table:
        """The rows of one key range: the facts as they came, and how many keys of each owner are shared;
        with ``whole`` also which, and their frequencies."""
        kinds = table.column("kind").to_numpy()
        facts = table.filter(pa.array(kinds == FACTS)).select([f for f, _ in FACT_FIELDS])
        entries, settled = table.filter(pa.array(kinds == ENTRIES)), table.filter(pa.array(kinds == SETTLED))
        raw = np.frombuffer(b"".join(entries.column("owners").to_pylist()), np.uint8).reshape(-1, OWNER_BYTES)
        owners = np.zeros((len(raw), 8), np.uint8)
        owners[:, :OWNER_BYTES] = raw
        keys, owners = np.frombuffer(b"".join(entries.column("keys").to_pylist()), "<u4"), owners.view("<u8").ravel()
        order = np.argsort(keys)
        counts = np.diff(runs(keys[order]))
        again = order[np.repeat(counts > 1, counts)]
        k, o = keys[again], owners[again]
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]) if len(k) else np.zeros(0, bool)
        k, o = k[fresh], o[fresh]
        edges = runs(k)
        df = np.add.reduceat(np.where(o == OWNER_MASK, self.cap, 1), edges[:-1]) if len(k) else np.zeros(0, np.int64)
        df = np.repeat(np.minimum(df, self.cap), np.diff(edges))
        keep = (df > 1) & (o != OWNER_MASK)
        part = np.uint64(table.column("part")[0].as_py()) << np.uint64(32)
        done = [np.frombuffer(b"".join(settled.column(c).to_pylist()), "<u8") for c in ("keys", "owners")]
        k = np.concatenate([k[keep].astype(np.uint64) | part, done[0]])
        o, d = np.concatenate([o[keep], done[1]]), np.concatenate([df[keep], np.full(len(done[0]), self.cap)]).astype(np.uint8)
        order = np.argsort(o, kind="stable")
        k, o, d = k[order], o[order], d[order]
        edges = runs(o)
        which = {"keys": cells(k.astype("<u8"), edges), "dfs": cells(d, edges)} if whole else {}
        hits = filled(SCREEN_ARROW, len(edges) - 1, owner=o[edges[:-1]].astype(np.int64), hits=np.diff(edges), **which)
        told = pa.Table.from_arrays([*(c.cast(t) for c, (_, t) in zip(facts.columns, FACT_FIELDS, strict=True)), *(pa.nulls(len(facts), f.type) for f in list(SCREEN_ARROW)[len(FACT_FIELDS) :])], schema=SCREEN_ARROW)
        return pa.concat_tables([told, pa.Table.from_batches([hits])])


def bits_for(sent: int) -> int:
    """Bits of the key range number, for so many sent shingles: 64 ranges at least, so that small inputs spread too."""
    return max(6, min(24, (sent // PER_RANGE).bit_length()))


def screen_for(docs: DataFrame, percent: int) -> Screen:
    """A partial screen with as many key ranges as the texts need."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return Screen(bits_for(size // TEXT_BYTES), percent)


def merged(packed: DataFrame, screen: Screen, whole: bool) -> DataFrame:
    """Packed rows, key range by key range."""

    def merge(table: pa.Table) -> pa.Table:
        return screen.merge(table, whole)

    return packed.groupBy("part").applyInArrow(merge, SCREEN)


def screened(docs: DataFrame, screen: Screen, shingles: Callable[[str], np.ndarray], identity: Callable[[np.ndarray], int]) -> DataFrame:
    """One row of facts per document (``owner`` is null), and how many sent keys of each owner are shared, in several rows; stored."""

    def pack(batches):
        def rows() -> Iterator[Row]:
            for doc_id, text, mark, mark2 in rows_of(batches, "doc_id", "text", "mark", "mark2"):
                found = shingles(text)
                who = identity(found) if len(found) else None
                yield (doc_id, mark, mark2, len(found), screen.lost(found), who), who, found

        yield from screen.pack(rows())

    return spool(merged(marked(docs).mapInArrow(pack, PACKED), screen, False).drop("keys", "dfs"), "shingle-screen")


def candidates(table: DataFrame, screen: Screen) -> DataFrame:
    """The classes (documents with equal sets) that the screen leaves: identity, n and doc_id, mark, mark2
    of their first document; stored."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "mark2")).alias("first")
    firsts = table.where("owner is null and n_shingles > 0").groupBy("identity").agg(first, F.first("n_shingles").alias("n"), F.first("lost").alias("lost"))
    hits = table.where("owner is not null").groupBy("owner").agg(F.sum("hits").alias("hits"))
    both = firsts.join(hits, F.col("identity").bitwiseAND(F.lit(OWNER_MASK)) == F.col("owner"))
    left = both.where(F.col("hits") + F.col("lost") >= screen.common_column(F.col("n")))
    return spool(left.select("identity", "n", "first.doc_id", "first.mark", "first.mark2"), "shingle-candidates")
