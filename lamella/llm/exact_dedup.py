"""Exact deduplication through a log-structured merge index of digests.

``flush`` turns a batch of documents into a level-0 run: every task is a memtable that
keeps one entry per (digest, doc_id), the entries of a digest meet, and the run is written
sorted by digest, as a table bucketed by digest, beside its filter. ``fanout`` runs of a level
are compacted into one of the next level, which keeps the smallest identifier of each
digest; equal bucketing lets the sorted runs merge bucket by bucket without a shuffle.

A filter is a bitmap over hashed digests (pieces of 2^15 bits, of which only those with a
bit set are stored). Filters are consulted before anything is joined: rows of a later batch
that no run's filter knows are new, and of the batch itself only rows that the filter of
repeated digests (hits) knows take part in a join or send their text to be verified. Hits
are verified on the normalised text itself, so that a digest collision never merges texts.

Digests that more than ``HOT`` rows have get a filter too: their rows are dealt to
``SALTS`` tasks and their one entry is copied to each.

Results for special rows: a null text counts as empty; null doc_ids sort after all
others (keep_id is null only if every id of the group is null); of repeated rows
with one doc_id and text one stays. Extra columns are ignored by ``duplicates`` and
kept by ``drop_duplicates`` and ``new_documents``. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.bitmap_filter import Filter
from lamella.llm.common import whole_text
from lamella.plans.spool import spool, spool_path

#: Runs of white space other than one plain space: one space is its own normal form.
NOT_ONE_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Rows of a digest beyond which they are dealt to several tasks, and to how many.
HOT = 4096
SALTS = 64


def normalised(column: Column) -> Column:
    """White-space runs ([\\x20\\x09-\\x0D]+) replaced by one space."""
    return F.regexp_replace(column, NOT_ONE_SPACE, " ")


def sha256_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _entries(docs: DataFrame, digest, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(whole_text()).alias("norm"), *more).withColumn("digest", digest(F.col("norm")))


def _turn(doc_id: str) -> Column:
    """Orders identifiers, nulls last."""
    return F.struct(F.col(doc_id).isNull(), F.col(doc_id))


class DigestIndex:
    """Runs of entries (digest, keep_id: its smallest identifier, n: rows, n_keep: rows that hold keep_id)
    by level, in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, digest=sha256_digest, fanout: int = 4) -> None:
        self.spark, self.digest, self.fanout = spark, digest, fanout
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[tuple[DataFrame, Filter]]] = []

    def _write(self, run: DataFrame) -> tuple[DataFrame, Filter]:
        name = f"lsm_{uuid.uuid4().hex}"
        run.write.option("compression", "zstd").option("path", spool_path(self.spark, "lsm-run")).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)
        table = self.spark.read.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files stay, and the DataFrame knows them
        return table, Filter(table.select("digest"), table.count(), 1 << 40)

    def flush(self, docs: DataFrame) -> DataFrame:
        """Write a batch as a level-0 run and return it; compact the levels that are full."""
        return self.flush_entries(_entries(docs, self.digest).select("doc_id", "digest"))

    def flush_entries(self, entries: DataFrame) -> DataFrame:
        """``flush`` of rows (doc_id, digest)."""
        per_id = entries.groupBy("digest", "doc_id").count()
        merged = per_id.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("count").alias("n"), F.min_by("count", _turn("doc_id")).alias("n_keep"))
        return self._add(0, merged.repartition(self.buckets, "digest"))

    def _add(self, level: int, run: DataFrame) -> DataFrame:
        while len(self.levels) <= level:
            self.levels.append([])
        written = self._write(run)
        self.levels[level].append(written)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._add(level + 1, self._merged([t for t, _ in full]))
        return written[0]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """The runs as one, merged by digest: bucket joins bucket, nothing is shuffled."""
        out = runs[0]
        for run in runs[1:]:
            other = run.select("digest", *(F.col(c).alias(f"__{c}") for c in ("keep_id", "n", "n_keep")))
            both = out.join(other, "digest", "full_outer")
            first, second = F.col("n").isNotNull(), F.col("__n").isNotNull()
            same = first & second & F.col("keep_id").eqNullSafe(F.col("__keep_id"))
            mine = first & (~second | (_turn("keep_id") <= _turn("__keep_id")))
            out = both.select(
                "digest",
                F.least("keep_id", "__keep_id").alias("keep_id"),
                (F.coalesce("n", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("n"),
                F.when(same, F.col("n_keep") + F.col("__n_keep")).when(mine, F.col("n_keep")).otherwise(F.col("__n_keep")).alias("n_keep"),
            )
        return out

    def runs(self) -> list[tuple[DataFrame, Filter]]:
        return [run for level in self.levels for run in level]

    def compact(self) -> DataFrame:
        """Merge all runs into one of the last level."""
        if len(runs := self.runs()) != 1:
            self.levels = [[] for _ in self.levels]
            self._add(len(self.levels), self._merged([t for t, _ in runs]))
        return self.runs()[0][0]

    def probe(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a digest) with ``held``: the smallest identifier of the index for the digest, as a
        struct, null where it has none. Only rows that a run's filter knows are joined with that run."""
        rows = rows.withColumn("held", F.lit(None).cast("struct<none:boolean,id:bigint>"))
        for run, filter_ in self.runs():
            seen = filter_.marked(rows, "digest", "__may")
            entry = run.select(F.col("digest").alias("__run"), F.struct(F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("id")).alias("__entry"))
            joined = seen.where("__may").join(entry, F.col("digest") == F.col("__run"), "left").withColumn("held", F.least("held", "__entry"))
            rows = seen.where("not __may").select(*rows.columns).unionByName(joined.select(*rows.columns))
        return rows


def _salted(rows: DataFrame, hot: Filter, copies: bool) -> DataFrame:
    """``rows`` with ``__salt``: several for a hot digest. ``copies``: a row for each of them."""
    marked = hot.marked(rows, "digest", "__hot")
    if copies:
        salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return marked.withColumn("__salt", F.explode(salts)).drop("__hot")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    return marked.withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(F.lit(0))).drop("__hot")


class Found:
    """The verified hits of one batch: its ``entries`` (doc_id, digest, mark; stored), the ``classes`` (digest,
    norm, keep_id, n, n_keep; stored) of the texts whose marks (hashes as they stand) are those of
    repeated digests, and ``collided`` (digests of several texts). Later passes look at marks, so
    that texts are normalised and digested once, and again only for hits."""

    def __init__(self, docs: DataFrame, digest) -> None:
        self.docs, self.digest = docs, digest
        self.entries = spool(_entries(docs.withColumn("__mark", F.xxhash64(whole_text())), digest, "__mark").select("doc_id", "digest", F.col("__mark").alias("mark")), "lsm-entries")
        run = DigestIndex(docs.sparkSession, digest).flush_entries(self.entries)
        sizes = run.agg(F.count(F.when(F.col("n") > 1, 1)).alias("hits"), F.count(F.when(F.col("n") > HOT, 1)).alias("hot")).first()
        self.hits = Filter(run.where("n > 1").select("digest"), sizes["hits"])
        self.hot = Filter(run.where(F.col("n") > HOT).select("digest"), sizes["hot"])
        marks = spool(self.hits.marked(self.entries, "digest", "__hit").where("__hit").select("mark").distinct(), "lsm-marks")
        self.marks = Filter(marks.select(F.col("mark").alias("digest")), marks.count())
        texts = _entries(self.may(docs).where("__may"), digest)
        # Equal rows of a task meet before the shuffle, so a hot group sends one row per task and identifier.
        per_id = texts.groupBy("digest", "norm", "doc_id").count()
        verified = per_id.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.sum("count").alias("n"), F.min_by("count", _turn("doc_id")).alias("n_keep"))
        self.classes = spool(verified, "lsm-verified")
        self.collided = spool(self.classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "lsm-collided")
        self.sound = self.collided.isEmpty()

    def may(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``__may``: whether the mark of the text is that of a hit."""
        return self.marks.marked(docs.withColumn("__mark", F.xxhash64(whole_text())), "__mark", "__may").drop("__mark")

    def known(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` (doc_id, digest; also norm unless ``sound``) that the filter of hits knows, with ``keep_id``, ``n``, ``n_keep``."""
        plain = self.classes.select("digest", "keep_id", "n", "n_keep").join(self.collided, "digest", "left_anti")
        entry = _salted(plain, self.hot, True).select(F.col("digest").alias("__of"), F.col("__salt").alias("__of_salt"), "keep_id", "n", "n_keep")
        dealt = _salted(rows, self.hot, False)
        found = dealt.join(entry, (F.col("digest") == F.col("__of")) & (F.col("__salt") == F.col("__of_salt"))).select(*columns, "digest", "keep_id", "n", "n_keep")
        if self.sound:
            return found
        # Texts that share a digest without being equal are told apart by their bytes.
        texts = self.classes.join(self.collided, "digest").select(F.col("digest").alias("__of"), F.col("norm").alias("__norm"), "keep_id", "n", "n_keep")
        rest = rows.join(texts, (F.col("digest") == F.col("__of")) & (F.col("norm") == F.col("__norm"))).select(*columns, "digest", "keep_id", "n", "n_keep")
        return found.unionByName(rest)


def duplicates(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    Of repeated rows (one doc_id, one text) a single row is marked as kept; only
    these few rows are numbered.
    """
    found = Found(docs, digest)
    rows = found.hits.marked(found.entries if found.sound else _entries(docs, digest), "digest", "__hit")
    alone = rows.where("not __hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "digest")
    again = found.known(rows.where("__hit").drop("__hit"), "doc_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    columns = ["doc_id", "keep_id", F.col("n").alias("group_size"), "kept", "digest"]
    if found.classes.where("n_keep > 1").isEmpty():
        return alone.unionByName(again.select(*columns))
    once = again.where("not kept or n_keep = 1").select(*columns)
    first = F.row_number().over(Window.partitionBy("digest", "keep_id").orderBy("doc_id")) == 1
    more = again.where("kept and n_keep > 1").withColumn("kept", first).select(*columns)
    return alone.unionByName(once).unionByName(more)


def drop_duplicates(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Documents whose marks are not those of hits pass by without a shuffle.
    """
    found = Found(docs, digest)
    rows = found.may(docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("__row"), "doc_id", "text"))
    alone = rows.where("not __may").select("__row.*")
    again = found.known(_entries(rows.where("__may"), digest, "__row"), "doc_id", "__row").where("doc_id <=> keep_id")
    if found.classes.where("n_keep > 1").isEmpty():
        return alone.unionByName(again.select("__row.*"))
    one = Window.partitionBy("digest", "keep_id").orderBy(F.xxhash64("__row"))
    more = again.where("n_keep > 1").withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return alone.unionByName(again.where("n_keep = 1").select("__row.*")).unionByName(more.select("__row.*"))


def new_documents(index: DigestIndex, docs: DataFrame, earlier: DataFrame) -> DataFrame:
    """The rows of a later batch whose text no document of the index has, with all their columns.

    ``earlier``: the documents that the index was made of. Rows that no filter knows are new;
    of ``earlier`` only the texts with the identifiers of hits are read, for their bytes. A digest
    that two texts of the index share stands for the text of its smallest identifier.
    """
    row = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("__row"), normalised(whole_text()).alias("norm"))
    probed = spool(index.probe(row.withColumn("digest", index.digest(F.col("norm")))), "lsm-probed")
    wanted = probed.where("held is not null").select("held.id").distinct()
    texts = _entries(earlier, index.digest).join(wanted, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select(F.col("digest").alias("__of"), F.col("norm").alias("__norm"))
    same = (F.col("digest") == F.col("__of")) & (F.col("norm") == F.col("__norm"))
    fresh = probed.where("held is not null").join(texts, same, "left_anti")
    return probed.where("held is null").select("__row.*").unionByName(fresh.select("__row.*"))
