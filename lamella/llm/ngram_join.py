"""Exact Jaccard join of documents on their word 5-grams, by adaptive multi-match prefixes.

Two documents link when 100 * |A and B| >= 75 * |A or B| for their sets of distinct
shingles. Shingles are ordered from rare to common. A document whose set of p shingles has m
or more in common with any partner's has, among its first p - m + l shingles, l or more in
common with the prefix of any partner; l = 1 is the usual prefix filter. Here each document
lengthens its prefix on its own: it takes the l with the least estimated cost, from the
document frequencies of the shingles it would add and the candidates that l matches would
leave. A pair is verified only if it shares as many prefix shingles as the smaller of the
two l.

Steps: documents with equal sets become one class. A partial ``shingle_screen`` keeps the
classes that may have a partner; only their texts are read again. A whole screen of their
sets tells which shingles they share and how many classes have them, hence the prefixes. First, each class is matched with one
head, a class that shares one of the few shingles of least hash with it, which links the
large groups; then exactly those pairs that lie in different components so far are formed
from the prefixes, counted and verified on their whole sets. So groups of thousands of
near copies do not turn into all their pairs, and no link between two components is lost.
Long lists are dealt by salts, and the pairs of a list or of a head are formed in blocks. Sets travel to their
verification as 32 bits a shingle, which can only make two sets look more alike; a pair
that so many false matches as may occur would decide is compared by whole hashes.

Special rows: null and empty texts, or those without words, have empty sets and link with
nothing; fewer than five words are one shingle; repeated rows are one class; a null doc_id
is never the smallest of a component unless it has no other. ``drop_near_duplicates`` keeps
exactly one row of each component (of its smallest doc_id, nulls last, the least text hash,
then the least row hash) and every row with an empty set; extra columns are kept. An empty
table gives an empty result. Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.attach import attached
from lamella.llm.bitmap_filter import only
from lamella.llm.common import out_batches, rows_of
from lamella.llm.components import components
from lamella.llm.shared_keys import keys_of
from lamella.llm.shingle_screen import CAP, MARKS, OWNER_MASK, PACKED, Screen, bits_for, candidates, marked, merged, screen_for, screened
from lamella.llm.words import mixed, sequences, signed, word_hashes
from lamella.plans.spool import spool

WORDS = 5
PERCENT = 75
#: Most shingles that a prefix is lengthened by, and the cost of verifying against one list entry.
MOST = 8
VERIFY = 8.0
#: Shingles of least hash by which a class looks for a head.
SKETCH = 16
#: Classes of a list in one block of its pairs, and the least number of salts.
BLOCK = 4096
SALTS = 64


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Ascending distinct hashes of the text's shingles."""
    found = text.encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    return np.unique(sequences(word_hashes(found), min(words, len(found))))


def identity(keys: np.ndarray) -> int:
    import xxhash

    return signed(xxhash.xxh3_64_intdigest(keys.tobytes(), seed=len(keys)))


def prefix(keys: np.ndarray, dfs: np.ndarray, need: int, cap: int = CAP) -> tuple[np.ndarray, int, np.ndarray]:
    """The shared shingles of a document's prefix, its l, and which of them are in ``cap`` sets or more.
    Unshared ones come before them.

    ``need``: how many of the set a partner has at least. None if too few are shared.
    """
    spare = len(keys) - need  # shared shingles in the prefix for l = 0
    if spare < 0:
        return keys[:0], 1, np.zeros(0, bool)
    order = np.lexsort((keys, dfs))
    entries = np.cumsum(dfs[order].astype(np.int64) - 1)
    ls = np.arange(1, max(1, min(MOST, need)) + 1)
    ends = np.minimum(spare + ls, len(keys))
    cost = entries[ends - 1] * (1 + VERIFY / ls)
    best = int(np.argmin(cost))
    some = order[: ends[best]]
    return keys[some], int(ls[best]), dfs[some] >= cap


#: 64-bit words of the parity bitmap.
LANES = 8
PARITY = [f"p{k}" for k in range(LANES)]
SETS_ARROW = pa.schema([("identity", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), *((p, pa.int64()) for p in PARITY)])
SETS = "identity bigint, n bigint, keys binary, " + ", ".join(f"{p} bigint" for p in PARITY)
CLASS_ARROW = pa.schema([("identity", pa.int64()), ("n", pa.int64()), ("l", pa.int64()), ("alone", pa.int64()), ("sketch", pa.binary()), ("few", pa.binary()), ("many", pa.binary())])
CLASS = "identity bigint, n bigint, l bigint, alone bigint, sketch binary, few binary, many binary"


def parity(keys: np.ndarray) -> list[int]:
    """A bitmap in which every key flips one bit. Two sets differ in at least as many keys as
    their bitmaps differ in bits."""
    bits = np.bincount((mixed(keys) % np.uint64(64 * LANES)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8").tolist()


def classes(sets: DataFrame, screen: Screen) -> DataFrame:
    """The classes that can have a partner, by a whole screen of the sets; stored.

    ``few`` and ``many`` are the prefix shingles that fewer than ``CAP`` classes have, or more;
    ``sketch`` the shared ones of least hash, ``alone`` how many in a thousand no other class
    has. Where two classes have one owner number, both get the prefix of all keys, which
    holds the prefixes of both.
    """

    def pack(batches):
        yield from screen.pack((None, who, np.frombuffer(keys, "<u8")) for who, keys in rows_of(batches, "identity", "keys"))

    def choose(batches):
        def rows() -> Iterator[tuple]:
            for who, n, need, lists in rows_of(batches, "identity", "n", "need", "lists"):
                keys, dfs = keys_of(lists)
                first, l, common_ones = prefix(keys, dfs, need, screen.cap)
                if len(first):
                    yield who, n, l, max(0, n - len(keys)) * 1000 // n, keys[:SKETCH].tobytes(), first[~common_ones].tobytes(), first[common_ones].tobytes()

        yield from out_batches(rows(), CLASS_ARROW)

    def lose(keys: pa.Array) -> pa.Array:
        return pa.array([screen.lost(np.frombuffer(x, "<u8")) for x in keys.to_pylist()], pa.int64())

    found = merged(sets.select("identity", "keys").mapInArrow(pack, PACKED), screen, True)
    lists = found.groupBy("owner").agg(F.sum("hits").alias("hits"), F.collect_list(F.struct("keys", "dfs")).alias("lists"))
    numbers = sets.select("identity", "n", F.arrow_udf(lose, "bigint")("keys").alias("lost"))
    need = F.greatest(F.lit(1), screen.common_column(F.col("n")) - F.col("lost"))
    both = numbers.withColumn("need", need).join(lists, F.col("identity").bitwiseAND(F.lit(OWNER_MASK)) == F.col("owner")).where("hits >= need")
    return spool(both.select("identity", "n", "need", "lists").mapInArrow(choose, CLASS), "shingle-classes")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """identity, n, keys and the parity bitmap of each class: one text of each is read again; stored."""

    def read(batches):
        seen: set[int] = set()

        def rows() -> Iterator[tuple]:
            for who, text in rows_of(batches, "identity", "text"):
                keys = shingles(text)
                if who not in seen and identity(keys) == who:  # not a repeated row, nor another text with the same doc_id and marks
                    seen.add(who)
                    yield who, len(keys), keys.tobytes(), *parity(keys)

        yield from out_batches(rows(), SETS_ARROW)

    # Most texts are not wanted: a bitmap of 8 MB at most keeps them from being shuffled.
    held = only(marked(docs), "mark", wanted, "mark")
    of = wanted.select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), F.col("mark2").alias("__mark2"), "identity")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark")) & (F.col("mark2") == F.col("__mark2"))
    return spool(held.join(of.hint("merge"), same).select("identity", "text").mapInArrow(read, SETS), "shingle-sets")


def lists_of(known: DataFrame, column: str, *names: str) -> DataFrame:
    """shingle, identity and the named columns (whole numbers) of each shingle in ``column``."""
    schema = pa.schema([("shingle", pa.int64()), ("identity", pa.int64()), *((n, pa.int64()) for n in names)])

    def spread(batches):
        for b in batches:
            raw = [np.frombuffer(x, "<i8") for x in b.column(column).to_pylist()]
            if raw:
                times = [len(x) for x in raw]
                columns = [np.concatenate(raw), *(np.repeat(b.column(c).to_numpy(zero_copy_only=False), times) for c in ("identity", *names))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return known.select("identity", *names, column).mapInArrow(spread, ", ".join(f"{f.name} bigint" for f in schema))


def may_link(percent: int = PERCENT):
    """Whether two sets (n, p0...; m, q0...) can be similar enough: they differ in at least the bits in
    which their bitmaps differ, and linked sets of n and m differ in (n + m) / 7 at most."""
    bits = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"q{k}"))) for k, p in enumerate(PARITY)), F.lit(0))
    return fits() & (bits * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, ...) whose sizes and bitmaps allow a link."""
    one = sets.select(F.col("identity").alias("a"), "n", *PARITY)
    two = sets.select(F.col("identity").alias("b"), F.col("n").alias("m"), *(F.col(p).alias(f"q{k}") for k, p in enumerate(PARITY)))
    pairs = spool(pairs, "shingle-met")
    return attached(pairs, "b", "a", two).join(one, "a").where(may_link()).select(*pairs.columns)


def common(x: bytes, y: bytes, kind: str) -> int:
    """How many of the ascending numbers of x are in y."""
    p, q = np.frombuffer(x, kind), np.frombuffer(y, kind)
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())


def similar(shared: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def false_matches(n: int, m: int) -> int:
    """More 32-bit numbers than this fall together by chance in one of some 10^9 pairs at most."""
    return 4 + int(16 * n * m / 2**32)


CHECKED_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link, by the shingles of both; stored."""

    def shorten(batches):
        for b in batches:
            short = [(np.frombuffer(x, "<u8") >> np.uint64(32)).astype("<u4").tobytes() for x in b.column("keys").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("identity"), pa.array(short, pa.binary())], names=["identity", "short"])

    def check(batches):
        def rows() -> Iterator[tuple]:
            for a, b, x, y in rows_of(batches, "a", "b", "x", "y"):
                n, m = len(x) // 4, len(y) // 4
                most = min(common(x, y, "<u4"), n, m)
                if similar(most, n, m):
                    yield a, b, similar(most - false_matches(n, m), n, m)

        yield from out_batches(rows(), CHECKED_ARROW)

    def check_whole(batches):
        def rows() -> Iterator[tuple]:
            for a, b, x, y in rows_of(batches, "a", "b", "x", "y"):
                if similar(common(x, y, "<u8"), len(x) // 8, len(y) // 8):
                    yield a, b, True

        yield from out_batches(rows(), CHECKED_ARROW)

    def joined(some: DataFrame, column: str, every: DataFrame) -> DataFrame:
        ids = some.select(F.col("a").alias("identity")).unionByName(some.select(F.col("b").alias("identity")))
        needed = every.join(ids, "identity", "left_semi")
        one, two = (needed.select(F.col("identity").alias(k), F.col(column).alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return attached(some.select("a", "b"), "b", "a", two).join(one, "a")

    short = sets.select("identity", "keys").mapInArrow(shorten, "identity bigint, short binary")
    schema = "a bigint, b bigint, sure boolean"
    found = spool(joined(spool(pairs, "shingle-pairs"), "short", short).mapInArrow(check, schema), "shingle-checked")
    close = joined(found.where("not sure"), "keys", sets).mapInArrow(check_whole, schema)
    return spool(found.where("sure").unionByName(close).select("a", "b"), "shingle-links")


def salts(spark) -> int:
    return max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hub_pairs(known: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: each class with the list head that it shares most of its sketch with; one pair per class at most.

    A list's head is its class with the least share of shingles of its own, such as the text
    that the others are copies of. A list's head reaches its classes by one row for each salt.
    """
    salt = F.pmod(F.xxhash64("identity"), F.lit(salts(known.sparkSession)))
    lists = lists_of(known, "sketch", "alone").withColumn("salt", salt)
    least_of = lists.groupBy("shingle", "salt").agg(F.min(F.struct("alone", "identity")).alias("first"), F.count(F.lit(1)).alias("n"))
    heads = least_of.groupBy("shingle").agg(F.min("first")["identity"].alias("b"), F.sum("n").alias("n")).where("n > 1").select("shingle", "b")
    by_salt = least_of.select("shingle", "salt").join(heads, "shingle")
    met = lists.join(by_salt, ["shingle", "salt"]).where("identity <> b").groupBy(F.col("identity").alias("a"), "b").count()
    return likely(met, sets).groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))


def fits() -> Column:
    """Whether sets of n and m may be similar enough."""
    return (F.col("n") * 100 >= F.col("m") * PERCENT) & (F.col("m") * 100 >= F.col("n") * PERCENT)


def cross_pairs(known: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """All candidate pairs (a, b) of classes in different components that share enough of their prefixes.

    Lists of fewer than ``CAP`` classes are joined with themselves in one row. In each longer list, the
    classes outside its most frequent component are joined with one another; each of them also meets
    that component, once for all lists where it does, and is then joined with its classes. So a text
    that is like a large group, but not enough to link, does not turn into a pair with each of its
    classes for every shingle that it shares. A list or component of more than ``BLOCK``
    classes is joined in as many blocks as it has so many.
    """
    rooted = known.join(roots, F.col("identity") == F.col("node"), "left").withColumn("root", F.coalesce("root", "identity"))
    few = lists_of(rooted, "few", "n", "l", "root").groupBy("shingle").agg(F.collect_list(F.struct("identity", "n", "l", "root")).alias("some")).where("size(some) > 1")
    each = few.select("some", F.explode("some").alias("x")).select("x", F.explode("some").alias("y")).where("x.root < y.root")
    short = each.select(F.col("x.identity").alias("a"), F.col("y.identity").alias("b"), F.col("x.l").alias("k"), F.col("y.l").alias("l"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).where(fits()).select("a", "b", "k", "l")

    salt = F.pmod(F.xxhash64("identity"), F.lit(salts(known.sparkSession))).alias("salt")
    marks_of = sets.select("identity", *PARITY)
    lists = lists_of(rooted.where("length(many) > 0").join(marks_of, "identity"), "many", "n", "l", "root", *PARITY).select("*", salt)
    counts = spool(lists.groupBy("shingle", "root", "salt").count(), "shingle-counts")
    by_root = counts.groupBy("shingle", "root").agg(F.sum("count").alias("count"))
    main = by_root.groupBy("shingle").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("size"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    marks = counts.join(main, "shingle").select("shingle", "root", "salt", "main", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    rest = lists.join(marks, ["shingle", "root", "salt"]).select("shingle", "identity", "n", "l", "root", *PARITY, "main", "blocks")
    left = rest.where("root <> main").select("shingle", F.col("identity").alias("a"), "n", F.col("l").alias("k"), F.col("root").alias("r"), *PARITY, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = rest.where("root <> main").select("shingle", F.col("identity").alias("b"), F.col("n").alias("m"), "l", "root", *(F.col(p).alias(f"q{k}") for k, p in enumerate(PARITY)), F.pmod(F.xxhash64("identity"), F.col("blocks")).alias("block"))
    long = left.join(right, ["shingle", "block"]).where((F.col("r") < F.col("root")) & may_link()).select("a", "b", "k", "l")

    met = short.unionByName(long).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = met.agg(F.count(F.lit(1)).alias("matches"), F.min(F.least("k", "l")).alias("need"))
    beside = main_pairs(rest, rooted.join(marks_of, "identity"))
    return likely(pairs.where("matches >= need").select("a", "b").unionByName(beside).distinct(), sets)


def main_pairs(rest: DataFrame, rooted: DataFrame) -> DataFrame:
    """a, b: each class that is in a list beside its most frequent component, with the classes of
    that component; at most one pair of each two classes for each of the two as ``a``."""
    big = rooted.groupBy("root").count().where(F.col("count") > BLOCK).select(F.col("root").alias("main"), F.ceil(F.col("count") / BLOCK).alias("blocks"))
    big, blocks = spool(big, "shingle-big"), F.coalesce("blocks", F.lit(1))
    beside = rest.where("root <> main").select(F.col("identity").alias("a"), "n", *PARITY, "main").dropDuplicates(["a", "main"])
    left = beside.join(big, "main", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).drop("blocks")
    within = rooted.select(F.col("root").alias("main"), F.col("identity").alias("b"), F.col("n").alias("m"), *(F.col(p).alias(f"q{k}") for k, p in enumerate(PARITY)))
    right = within.join(big, "main", "left").withColumn("block", F.pmod(F.xxhash64("b"), blocks)).drop("blocks")
    return left.join(right, ["main", "block"]).where(may_link()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def linked_classes(table: DataFrame, docs: DataFrame, screen: Screen, first: Column, least: str) -> DataFrame:
    """__who, n_classes and, as ``least``, the least ``first`` of its component for each class; stored."""
    sets = whole_sets(docs, candidates(table, screen))
    total = sets.agg(F.sum("n")).first()[0] or 0
    known = classes(sets, Screen(bits_for(total), PERCENT, None, screen.cap, screen.per_flush))
    links = verified(hub_pairs(known, sets), sets)
    roots = components(links)
    links = links.unionByName(verified(cross_pairs(known, roots, sets), sets))
    roots = components(links)
    firsts = table.where("owner is null and n_shingles > 0").groupBy("identity").agg(F.min(first).alias("first"))
    rooted = firsts.join(roots, firsts["identity"] == roots["node"], "left").select("identity", "first", F.coalesce("root", "identity").alias("root"))
    lowest = spool(rooted, "shingle-roots")
    least_id = lowest.groupBy("root").agg(F.min("first").alias(least), F.count(F.lit(1)).alias("n_classes"))
    named = lowest.join(least_id, "root").select(F.col("identity").alias("__who"), least, "n_classes")
    return spool(named, "shingle-components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    screen = screen_for(docs, PERCENT)
    table = screened(docs, screen, shingles, identity)
    named = linked_classes(table, docs, screen, F.col("doc_id"), "component_id")
    rows = table.where("owner is null")
    full = rows.where("n_shingles > 0")
    linked = full.join(named, full["identity"] == named["__who"]).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id, and those without words; all columns.

    Rows are told apart by doc_id and text; only rows that repeat a kept one are numbered.
    """
    screen = screen_for(docs, PERCENT)
    table = screened(docs, screen, shingles, identity)
    rows = table.where("owner is null and n_shingles > 0")
    turn = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *MARKS)
    named = linked_classes(table, docs, screen, turn, "__keep")
    keyed = rows.join(named, rows["identity"] == named["__who"]).select(turn.alias("__turn"), "__keep")
    drop = keyed.where("__turn <> __keep").distinct().select(F.col("__turn").alias("__of"), F.lit(True).alias("__gone"))
    again = keyed.where("__turn = __keep").groupBy("__turn").count().where("count > 1").select(F.col("__turn").alias("__of"), F.lit(False).alias("__gone"))
    fate = spool(drop.unionByName(again), "shingle-fate")
    parts = {"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), **{f"__{c}": hashed() for c, hashed in MARKS.items()}}
    flat = fate.select(F.col("__of.none").alias("__n"), F.coalesce("__of.doc_id", F.lit(0)).alias("__d"), F.col("__of.mark").alias("__m"), F.col("__of.mark2").alias("__m2"), "__gone")
    marked = docs.select("*", *(c.alias(n) for n, c in parts.items()))
    same = (F.col("__none") == F.col("__n")) & (F.col("__id") == F.col("__d")) & (F.col("__mark") == F.col("__m")) & (F.col("__mark2") == F.col("__m2"))
    repeated = flat.where("not __gone")
    if repeated.isEmpty():
        return marked.join(flat, same, "left_anti").select(*docs.columns)
    known = marked.join(flat, same, "left").where("__gone is null or not __gone")
    one = Window.partitionBy(*parts).orderBy(F.xxhash64(*docs.columns))
    more = known.where("not __gone").withColumn("__place", F.row_number().over(one)).where("__place = 1")
    return known.where("__gone is null").select(*docs.columns).unionByName(more.select(*docs.columns))
