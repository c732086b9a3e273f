"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of every 13 consecutive words (a window), the smallest hash of
the nine 5-word sequences within. Equal windows have equal anchors, so passages of 13 words
or more that two texts share have an anchor in common, and texts without a shared anchor
are done. The windows around the shared anchors are told by their hashes, and each that a
document with a smaller doc_id has too gets one such holder. A seed is extended on the words
themselves: a stretch of windows with one holder goes to that holder's text, is laid to every
place where its first window stands there, and followed to the left and the right as far
as the words agree; the longest match counts, and what it leaves is laid anew. Windows
that agree by hash only are no repeats. Overlapping repeats merge into maximal ones, and
their words go.

Equal texts are one class, held by its smallest doc_id; the other members are repeats as a
whole. Each repeated window is settled by one holder (one entry per task), never by pairs
of its holders, and a holder of many stretches is copied to as many tasks as they need. (A
window whose hash that of other words hides is kept: with 64 bits, some two in 10^13.)

Special rows: null and empty texts have no words; fewer than 13 words have no window and
keep all; rows of one doc_id do not repeat one another, whether their texts are equal or
not; a null doc_id counts as larger than all others, and rows without one do not repeat one
another (the largest bigint stands for none, so a doc_id of 2^63 - 1 comes back as null). Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.attach import attached
from lamella.llm.bitmap_filter import only
from lamella.llm.common import out_batches, rows_of, whole_text
from lamella.llm.shared_keys import Packing, gathered, holders_of, keys_of, ranges_for, shared
from lamella.llm.words import sequences, signed, sliding_min, word_hashes
from lamella.plans.spool import spool

WINDOW = 13
SEED = 5
#: Stands for a null doc_id.
LAST = (1 << 63) - 1


def windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window and its anchor."""
    hashes = word_hashes(words)
    return sequences(hashes, WINDOW), sliding_min(sequences(hashes, SEED), WINDOW - SEED + 1)


def identity(words: list[bytes]) -> int:
    import xxhash

    return signed(xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words)))


def among(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)
    return ascending[at] == x


def covered(hit: np.ndarray, n: int) -> np.ndarray:
    """The words that windows beginning at ``hit`` cover."""
    edges = np.zeros(n + 1, np.int32)
    edges[: len(hit)] += hit
    edges[WINDOW : WINDOW + len(hit)] -= hit
    return np.cumsum(edges[:n]) > 0


def spans(cover: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered words, end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


FACTS_ARROW = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("identity", pa.int64()), ("words_sha256", pa.string())])


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text as it stands), n_words, identity, words_sha256 of each document; stored."""

    def measure(batches):
        def rows() -> Iterator[tuple]:
            for doc_id, mark, text in rows_of(batches, "doc_id", "mark", "text"):
                words = text.encode("utf-8").split()
                yield doc_id, mark, len(words), identity(words), hashlib.sha256(b" ".join(words)).hexdigest()

        yield from out_batches(rows(), FACTS_ARROW)

    return spool(_texts(docs).withColumn("mark", F.xxhash64("text")).mapInArrow(measure, "doc_id bigint, mark bigint, n_words bigint, identity bigint, words_sha256 string"), "substring-facts")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), whole_text().alias("text"))


def seeded(docs: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """doc_id, text, identity, anchors of each class that shares an anchor with another; stored.

    A class's text is found by its owner's doc_id and the text's mark, since one doc_id, or
    none, may have many texts.
    """

    def texts(batches):
        for (text,) in rows_of(batches, "text"):
            words = text.encode("utf-8").split()
            if len(words) >= WINDOW:
                yield identity(words), len(words), np.unique(windows(words)[1])

    found = gathered(shared(_texts(docs), texts, Packing("shared", ranges_for(total // 5), 6)))
    owners = rows.where(F.col("n_words") >= WINDOW).groupBy("identity").agg(F.min(F.struct("doc_id", "mark")).alias("owner"))
    wanted = spool(found.join(owners, "identity").select(F.col("owner.doc_id").alias("owner"), F.col("owner.mark").alias("mark"), F.col("identity"), "lists"), "substring-anchors")
    texts_of = only(_texts(docs).withColumn("__mark", F.xxhash64("text")), "__mark", wanted, "mark").drop("__mark").join(wanted, (F.col("doc_id") == F.col("owner")) & (F.xxhash64("text") == F.col("mark")))
    return spool(texts_of.select("doc_id", "text", "identity", "lists"), "substring-seeded")


def repeats(seeds: DataFrame, total: int) -> DataFrame:
    """who, n, lists: the windows (hashes) of each class that a smaller doc_id has too; stored."""
    anchors = Packing("shared", ranges_for(total // 5), 6)

    def texts(batches):
        for doc_id, text, who, lists in rows_of(batches, "doc_id", "text", "identity", "lists"):
            words = text.encode("utf-8").split()
            if identity(words) == who:  # another text may have the same doc_id and mark
                whole, anchor = windows(words)
                near = whole[among(anchors.canonical(anchor), keys_of(lists)[0])]
                yield who, len(words), np.unique(near), doc_id

    found = shared(seeds, texts, Packing("low", ranges_for(total // 8), 8))
    return spool(gathered(found).select(F.col("identity").alias("who"), F.col("size").alias("n"), F.col("lists").alias("repeated")), "substring-repeats")


def stretches(holders: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last window of each run of hits that have one holder."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    breaks = np.flatnonzero((np.diff(at) > 1) | (holders[at][1:] != holders[at][:-1])) + 1
    return [(int(x[0]), int(x[-1])) for x in np.split(at, breaks)]


def extended(part: list[bytes], whole: list[bytes], places: dict[int, list[int]]) -> np.ndarray:
    """Which windows of ``part`` stand in ``whole``, by the longest matches. ``places``: where windows of ``whole`` stand."""
    found = np.zeros(max(0, len(part) - WINDOW + 1), bool)
    hashes = sequences(word_hashes(part), WINDOW).tolist()
    at = 0
    while at < len(found):
        best = (0, 0)
        for p in places.get(hashes[at], ()):  # ascending, so what is left of ``whole`` gets shorter
            if best[0] >= min(len(part) - at, len(whole) - p):
                break
            left, right = 0, 0
            while left < at and left < p and part[at - left - 1] == whole[p - left - 1]:
                left += 1
            while at + right < len(part) and p + right < len(whole) and part[at + right] == whole[p + right]:
                right += 1
            best = max(best, (right, left))
        right, left = best
        if right >= WINDOW:
            found[at - left : at + right - WINDOW + 1] = True
        at += max(1, right - WINDOW + 1)
    return found


CUT = "kind int, doc_id bigint, identity bigint, n_removed bigint, kept_sha256 string, kept string, repeats array<struct<start:int,end:int>>, holder bigint, first int, part binary"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
CUT_ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("identity", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("repeats", SPANS), ("holder", pa.int64()), ("first", pa.int32()), ("part", pa.binary())])
LEFT, STRETCH = 0, 1


def what_is_left(doc_id: int, who: int, words: list[bytes], cover: np.ndarray, texts: bool) -> tuple:
    left = b" ".join(w for w, c in zip(words, cover.tolist(), strict=True) if not c)
    return LEFT, doc_id, who, int(cover.sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8") if texts else None, [{"start": s, "end": e} for s, e in spans(cover)] if texts else None, None, None, None


def cut(seeds: DataFrame, found: DataFrame, texts: bool) -> DataFrame:
    """What would be left of each class that has repeats, with the maximal repeats (words, end exclusive),
    and the stretches to be held against their holders; stored."""

    def keep(batches):
        def rows() -> Iterator[tuple]:
            for doc_id, text, who, n, lists in rows_of(batches, "doc_id", "text", "identity", "n", "repeated"):
                words = text.encode("utf-8").split()
                if len(words) != n or identity(words) != who:
                    continue
                whole, (keys, holders) = windows(words)[0], holders_of(lists)
                hit = among(whole, keys)
                holder = holders[np.minimum(np.searchsorted(keys, whole), len(keys) - 1)]
                yield what_is_left(doc_id, who, words, covered(hit, n), texts)
                for first, last in stretches(holder, hit):
                    yield STRETCH, doc_id, who, None, None, None, None, int(holder[first]), first, b" ".join(words[first : last + WINDOW])

        yield from out_batches(rows(), CUT_ARROW, size=512)

    held = only(seeds.select("doc_id", "text", "identity"), "identity", found, "who").join(found, F.col("identity") == F.col("who"))
    return spool(held.select("doc_id", "text", "identity", "n", "repeated").mapInArrow(keep, CUT), "substring-cut")


FAILED_ARROW = pa.schema([("doc_id", pa.int64()), ("identity", pa.int64()), ("holder", pa.int64()), ("at", pa.int32())])


def failed(stretched: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc_id, identity, at: windows whose words their holder does not have; stored. Next to none."""

    def extend(batches):
        def rows() -> Iterator[tuple]:
            known, whole, places = None, [], {}
            for doc_id, who, holder, first, part, text in rows_of(batches, "doc_id", "identity", "holder", "first", "part", "text"):
                if known != (holder, len(text)):
                    known, whole, places = (holder, len(text)), text.encode("utf-8").split(), {}
                    for i, h in enumerate(windows(whole)[0].tolist()):
                        places.setdefault(h, []).append(i)
                for at in np.flatnonzero(~extended(part.split(), whole, places)).tolist():
                    yield doc_id, who, holder, first + at

        yield from out_batches(rows(), FAILED_ARROW)

    holders = only(seeds.select("identity", "text"), "identity", spool(stretched.select("holder").distinct(), "substring-holders"), "holder")
    texts = holders.dropDuplicates(["identity"]).select(F.col("identity").alias("holder"), "text")
    both = attached(stretched, "holder", "part", texts).sortWithinPartitions("holder")
    return spool(both.select("doc_id", "identity", "holder", "first", "part", "text").mapInArrow(extend, "doc_id bigint, identity bigint, holder bigint, at int").drop("holder"), "substring-failed")


def cut_again(seeds: DataFrame, found: DataFrame, wrong: DataFrame, texts: bool) -> DataFrame:
    """``cut`` for the classes with failed windows, without those."""

    def keep(batches):
        def rows() -> Iterator[tuple]:
            for doc_id, text, who, n, lists, at in rows_of(batches, "doc_id", "text", "identity", "n", "repeated", "at"):
                words = text.encode("utf-8").split()
                if len(words) == n and identity(words) == who:
                    hit = among(windows(words)[0], keys_of(lists)[0])
                    hit[at] = False
                    yield what_is_left(doc_id, who, words, covered(hit, n), texts)

        yield from out_batches(rows(), CUT_ARROW, size=512)

    lost = wrong.groupBy(F.col("identity").alias("__who")).agg(F.collect_list("at").alias("at"))
    held = seeds.select("doc_id", "text", "identity").join(found, F.col("identity") == F.col("who")).join(lost, F.col("identity") == F.col("__who"))
    return held.select("doc_id", "text", "identity", "n", "repeated", "at").mapInArrow(keep, CUT)


def deduplicated(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document; with ``texts`` also kept (null if
    nothing was removed) and repeats."""
    rows = facts(docs)
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    seeds = seeded(docs, rows, total)
    repeated = repeats(seeds, total)
    ready = cut(seeds, repeated, texts)
    wrong = failed(ready.where(F.col("kind") == STRETCH), seeds)
    done = ready.where(F.col("kind") == LEFT)
    if not wrong.isEmpty():
        mended = spool(cut_again(seeds, repeated, wrong, texts), "substring-mended")
        done = done.join(wrong.select("doc_id", "identity").distinct(), ["doc_id", "identity"], "left_anti").unionByName(mended)
    done = done.dropDuplicates(["doc_id", "identity"])
    owners = spool(rows.where(F.col("n_words") >= WINDOW).groupBy("identity").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("members")).where("members > 1"), "substring-owners")
    copies = rows.join(owners.select(F.col("identity").alias("__who"), "owner"), F.col("identity") == F.col("__who"), "left")
    copy = F.col("owner").isNotNull() & (F.col("doc_id") != F.col("owner"))
    ended = done.select(F.col("doc_id").alias("__doc"), F.col("identity").alias("__same"), "n_removed", "kept_sha256", "kept", "repeats")
    joined = copies.join(ended, (F.col("doc_id") == F.col("__doc")) & (F.col("identity") == F.col("__same")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    out = joined.select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))).otherwise(F.col("repeats")).alias("repeats"),
    )
    return out if texts else out.drop("kept", "repeats")
