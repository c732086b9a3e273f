"""One query per operator group over the test tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import paths as P
from lamella.functions import scalars as S
from lamella.operators import content, devices, layout, report, traces, tree
from lamella.plans.numbering import number_rows, ordered_lag, ordered_total
from lamella.plans.spool import spool
from lamella.sources import codecs, container

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- content and sizes over documents ---------------------------------------------------

BOUND = "(512 + (512 >> 12) + (512 >> 14) + (512 >> 25) + 13)"


@query(f"""
WITH c AS (SELECT text, strlen(text) AS size, count(*) AS members FROM documents GROUP BY text),
b AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE (size - 1) // 512 + 1 END AS blocks FROM c)
SELECT sum(members)::BIGINT AS n_files, sum(size * members)::BIGINT AS total_bytes, sum(size)::BIGINT AS distinct_bytes, sum(members - 1)::BIGINT AS n_duplicates,
  sum(blocks * members)::BIGINT AS n_blocks, sum({BOUND} * blocks)::BIGINT AS upper_bound FROM b""")
def dup_summary(spark, sf_dir):
    return content.totals(table(spark, sf_dir, "documents"), "doc_id", "text", 512)


@query("SELECT strlen(text) AS size, count(*) AS members, min(doc_id) AS leader FROM documents GROUP BY text HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return content.content_classes(table(spark, sf_dir, "documents"), "doc_id", "text").where("members > 1").select("size", "members", "leader")


@query("SELECT doc_id, strlen(text) AS size, min(doc_id) OVER (PARTITION BY text) AS leader, doc_id <> min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents")
def dup_leader_map(spark, sf_dir):
    return content.leaders(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query("""SELECT doc_id, strlen(text) AS size, CASE WHEN strlen(text) = 0 THEN 0 ELSE (strlen(text) - 1) // 4096 + 1 END AS blocks,
  CASE WHEN strlen(text) = 0 THEN 4096 ELSE ((strlen(text) - 1) | 4095) + 1 END AS rounded, 12 AS shift FROM documents""")
def blocks_needed(spark, sf_dir):
    size = S.size_of("text")
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), S.blocks_needed(size, 4096).alias("blocks"), S.round_up(size, 4096).alias("rounded"), S.shift_of(F.lit(4096)).alias("shift"))


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source", "doc_id", S.size_of("text").alias("size"))


BLOCKS = """b AS (SELECT lang, source, doc_id, strlen(text) AS size, unnest(generate_series(0, (strlen(text) - 1) // 512)) AS blk_nr FROM documents WHERE strlen(text) > 0),
l AS (SELECT *, least(512, size - blk_nr * 512)::BIGINT AS blk_length FROM b)"""


@query(f"WITH {BLOCKS} SELECT doc_id, blk_nr, blk_nr * 512 AS blk_offset, blk_length FROM l")
def block_explode(spark, sf_dir):
    return layout.blocks(_files(spark, sf_dir), 512).select("doc_id", "blk_nr", "blk_offset", "blk_length")


@query(f"""WITH {BLOCKS} SELECT doc_id, blk_nr, coalesce(sum(blk_length) OVER (ORDER BY lang, source, doc_id, blk_nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ptr FROM l""")
def blkptr_layout(spark, sf_dir):
    return layout.pointers(layout.blocks(_files(spark, sf_dir), 512), ["lang", "source", "doc_id", "blk_nr"], "blk_length").select("doc_id", "blk_nr", "ptr")


@query(f"""WITH {BLOCKS}, p AS (SELECT *, coalesce(sum(blk_length) OVER (ORDER BY lang, source, doc_id, blk_nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ptr FROM l)
SELECT doc_id, blk_nr, coalesce(lead(ptr) OVER (PARTITION BY doc_id ORDER BY blk_nr), ptr + blk_length) - ptr AS length FROM p""")
def blkptr_length(spark, sf_dir):
    placed = layout.pointers(layout.blocks(_files(spark, sf_dir), 512), ["lang", "source", "doc_id", "blk_nr"], "blk_length")
    return layout.lengths(placed.withColumn("end", F.col("ptr") + F.col("blk_length")), ["doc_id"], "blk_nr", "end").select("doc_id", "blk_nr", "length")


@query(f"""WITH {BLOCKS}, r AS (SELECT doc_id, size, unnest(generate_series(0, (size - 1) // 4096)) AS page_nr FROM (SELECT doc_id, strlen(text) AS size FROM documents WHERE strlen(text) > 0)),
c AS (SELECT doc_id, page_nr, unnest(generate_series(page_nr * 4096 // 512, (page_nr * 4096 + 4095) // 512)) AS blk_nr FROM r)
SELECT c.doc_id, page_nr, count(*) AS n_blocks, sum(blk_length)::BIGINT AS page_bytes FROM c JOIN l ON l.doc_id = c.doc_id AND l.blk_nr = c.blk_nr GROUP BY c.doc_id, page_nr""")
def page_blocks(spark, sf_dir):
    files = _files(spark, sf_dir)
    pages = layout.blocks(files, 4096).select("doc_id", F.col("blk_nr").alias("page_nr"))
    wanted = layout.covering_blocks(pages, 4096, 512)
    held = layout.blocks(files, 512).select("doc_id", "blk_nr", "blk_length")
    return wanted.join(held, ["doc_id", "blk_nr"]).groupBy("doc_id", "page_nr").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("blk_length").alias("page_bytes"))


@query("SELECT lang AS class, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
def type_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(S.size_of("text")).alias("bytes"))


@query("""WITH s AS (SELECT strlen(text)::BIGINT AS n FROM documents) SELECT
  sum(n + (n >> 12) + (n >> 14) + (n >> 25) + 13)::BIGINT AS zlib, sum(n + n // 255 + 16)::BIGINT AS lz4, sum(n + n // 16 + 67)::BIGINT AS lzo,
  sum(n + (n >> 8) + CASE WHEN n < 131072 THEN (131072 - n) >> 11 ELSE 0 END)::BIGINT AS zstd FROM s""")
def upper_bound(spark, sf_dir):
    n = S.size_of("text")
    return table(spark, sf_dir, "documents").agg(*(F.sum(S.worst_case(c, n)).cast("bigint").alias(c) for c in ("zlib", "lz4", "lzo", "zstd")))


@query("""SELECT doc_id, strlen(text) AS size, CASE WHEN strlen(text) > 16384 THEN 'error' WHEN strlen(text) > 8192 THEN 'warning' ELSE 'ok' END AS verdict FROM documents""")
def size_limits(spark, sf_dir):
    size = S.size_of("text")
    verdict = F.when(size > 16384, "error").when(size > 8192, "warning").otherwise("ok")
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), verdict.alias("verdict"))


@query("""SELECT doc_id, coalesce(size, -1) AS size, CASE WHEN size IS NULL THEN 'unreadable' WHEN size = 0 THEN 'empty' END AS skip_reason
FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN NULL WHEN lang = 'fr' THEN 0 ELSE strlen(text) END AS size FROM documents)""")
def filter_skip_reason(spark, sf_dir):
    size = F.when(F.col("lang") == "fr", F.lit(0)).when(F.col("lang") != "de", F.octet_length("text")).cast("bigint")
    marked = content.skip_reason(table(spark, sf_dir, "documents").select("doc_id", size.alias("size")))
    return marked.withColumn("size", F.coalesce("size", F.lit(-1)))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query()
def crc32_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), F.sha2("text", 512).alias("sha512"))


@query("SELECT count(*) AS n_files, sum(strlen(text))::BIGINT AS bytes, sum((strlen(text) + 4095) // 4096)::BIGINT AS n_blocks, 4096 AS block_size, 0 AS n_free, 255 AS name_max FROM documents")
def statfs(spark, sf_dir):
    size = S.size_of("text")
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("bytes"), F.sum(S.blocks_needed(size, 4096)).alias("n_blocks")).select("*", F.lit(4096).alias("block_size"), F.lit(0).alias("n_free"), F.lit(255).alias("name_max"))


@query("""WITH c AS (SELECT doc_id, unnest([{'codec': 'zlib', 'ord': 1, 'len': n + (n >> 12) + 13}, {'codec': 'lz4', 'ord': 2, 'len': n + n // 255 + 16}, {'codec': 'lzo', 'ord': 3, 'len': n + n // 16 + 67}]) AS x
  FROM (SELECT doc_id, strlen(text)::BIGINT AS n FROM documents))
SELECT doc_id, min(x.len)::BIGINT AS best_length, arg_min(x.codec, x.len * 10 + x.ord) AS best FROM c GROUP BY doc_id""")
def best_encoding(spark, sf_dir):
    """The least worst-case length by the codecs' bounds; ``best_block_encoding`` encodes."""
    n = F.col("n")
    choices = F.array(
        F.struct(F.lit("zlib").alias("codec"), F.lit(1).alias("ord"), (n + F.shiftright(n, 12) + 13).alias("len")),
        F.struct(F.lit("lz4").alias("codec"), F.lit(2).alias("ord"), (n + F.expr("n div 255") + 16).alias("len")),
        F.struct(F.lit("lzo").alias("codec"), F.lit(3).alias("ord"), (n + F.expr("n div 16") + 67).alias("len")),
    )
    each = table(spark, sf_dir, "documents").select("doc_id", S.size_of("text").alias("n")).select("doc_id", F.inline(choices))
    return report.smallest(each, "doc_id", "codec", "len", "ord")


#: What each block is encoded with for the choice of the smallest; the first on ties.
CHOICES = [("zlib", None), ("lz4", None), ("zstd", 3), ("xz", 0), *((f"xz+{name}", 0) for name in codecs.BCJ)]


@query()
def best_block_encoding(spark, sf_dir):
    """Each block under every available codec and filter; the smallest real encoding wins."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), S.size_of("text").alias("size"))
    cut = layout.blocks(docs, 4096).select(F.struct("doc_id", "blk_nr").alias("block"), F.expr("substring(content, int(blk_offset) + 1, int(blk_length))").alias("plain"))
    best = report.smallest(codecs.candidates(cut, "block", "plain", CHOICES), "block", "codec", "len", "ord")
    return best.select("block.doc_id", "block.blk_nr", "best_length", "best")


@query("""WITH l AS (SELECT doc_id, lang, source FROM documents), r AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'xx' ELSE lang END AS lang, source FROM documents)
SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""")
def tree_diff(spark, sf_dir):
    left = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    right = left.withColumn("lang", F.when(F.col("lang") == "de", "xx").otherwise(F.col("lang")))
    return tree.differences(left, right)


# --- trees over the paths of pages -------------------------------------------------------

PATHS = r"""p AS (SELECT page_id, strlen(html)::BIGINT AS size, regexp_replace(regexp_extract(url, '^https?://([^?#]+)', 1), '/+', '/', 'g') AS path FROM pages),
parts AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p WHERE path <> ''),
each AS (SELECT page_id, size, parts, unnest(generate_series(1, len(parts))) AS depth FROM parts WHERE len(parts) > 0),
nodes AS (SELECT DISTINCT array_to_string(parts[1:depth], '/') AS path, CASE WHEN depth = 1 THEN '' ELSE array_to_string(parts[1:depth-1], '/') END AS parent, parts[depth] AS name, depth FROM each)"""


def _pages(spark, sf_dir):
    path = F.regexp_replace(F.regexp_extract("url", "^https?://([^?#]+)", 1), "/+", "/")
    return table(spark, sf_dir, "pages").select("page_id", S.size_of("html").alias("size"), path.alias("path")).where("path <> ''")


def _nodes(spark, sf_dir):
    return tree.nodes(_pages(spark, sf_dir), "path")


@query(f"""WITH {PATHS} SELECT path, coalesce(sum(15 + strlen(name)) OVER (ORDER BY parent, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 77 AS ptr FROM nodes""")
def metadata_layout(spark, sf_dir):
    records = _nodes(spark, sf_dir).withColumn("record", layout.record_size("name"))
    return layout.pointers(records, ["parent", "name"], "record", container.SUPERBLOCK).select("path", "ptr")


@query(f"WITH {PATHS} SELECT parent, count(*) AS n_entries, sum(15 + strlen(name))::BIGINT AS dir_bytes FROM nodes GROUP BY parent")
def dir_sizes(spark, sf_dir):
    return tree.directory_sizes(_nodes(spark, sf_dir))


@query(f"WITH {PATHS} SELECT array_to_string(parts[1:depth], '/') AS path, count(*) AS n_leaves, sum(size)::BIGINT AS total_bytes FROM each GROUP BY 1")
def subtree_rollup(spark, sf_dir):
    return tree.subtree_totals(_pages(spark, sf_dir), "path", "size")


@query(f"""WITH RECURSIVE {PATHS}, walk(path, depth) AS (SELECT path, 1 FROM nodes WHERE parent = '' UNION ALL SELECT n.path, w.depth + 1 FROM walk w JOIN nodes n ON n.parent = w.path)
SELECT path, depth::INT AS depth FROM walk""")
def tree_recursive(spark, sf_dir):
    return tree.walked(spark, spool(_nodes(spark, sf_dir), "tree"))


@query(f"WITH {PATHS} SELECT parent, name FROM nodes WHERE parent > '' ORDER BY parent, name LIMIT 50")
def dir_listing_page(spark, sf_dir):
    """The next 50 entries after the top directories: a listing resumes at its cursor."""
    return tree.page_after(_nodes(spark, sf_dir), ("", "￿"), 50)


@query(f"""WITH {PATHS}, w AS (SELECT path FROM nodes UNION ALL SELECT path || '/none' FROM nodes)
SELECT w.path, n.path IS NOT NULL AS found, coalesce(n.depth, 0)::INT AS depth FROM w LEFT JOIN nodes n ON n.path = w.path""")
def path_lookup(spark, sf_dir):
    known = _nodes(spark, sf_dir)
    wanted = known.select("path").unionAll(known.select(F.concat("path", F.lit("/none")).alias("path")))
    return tree.lookup(known, wanted).withColumn("depth", F.coalesce("depth", F.lit(0)))


@query(r"""WITH u AS (SELECT page_id, regexp_replace(url, '^https?:/', '') || '//' AS raw FROM pages), n AS (SELECT *, regexp_replace(raw, '/+', '/', 'g') AS one FROM u)
SELECT page_id, CASE WHEN one = '/' THEN one ELSE regexp_replace(one, '/$', '') END AS path FROM n""")
def path_normalise(spark, sf_dir):
    raw = F.concat(F.regexp_replace("url", "^https?:/", ""), F.lit("//"))
    return table(spark, sf_dir, "pages").select("page_id", P.normalised(raw).alias("path"))


@query(r"""SELECT page_id, (len(list_filter(string_split(regexp_replace(url, '^https?:/', ''), '/'), lambda x: x <> '')) + 1)::INT AS levels FROM pages""")
def path_levels(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.levels(F.regexp_replace("url", "^https?:/", "")).alias("levels"))


@query(r"""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?:/', ''), '/+', '/', 'g'), '/$', '') AS path FROM pages), c AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS cut FROM n)
SELECT page_id, CASE WHEN cut = '' AND path <> '/' THEN '/' ELSE cut END AS parent FROM c""")
def path_parent(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.parent(F.regexp_replace("url", "^https?:/", "")).alias("parent"))


@query(r"""SELECT page_id AS id, url AS path FROM pages UNION ALL SELECT doc_id AS id, lang || '/' || source AS path FROM documents""")
def path_list_union(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", "source").alias("path"))
    return pages.unionByName(docs)


@query("SELECT page_id, regexp_replace(url, '[^-a-zA-Z0-9]', '_', 'g') AS slug FROM pages")
def path_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.slug(F.col("url")).alias("slug"))


# --- flags, modes, codecs, devices -------------------------------------------------------


@query("""SELECT o_orderkey, (o_orderkey & 65280)::BIGINT AS codec_bits, (o_orderkey & ~8191::BIGINT) <> 0 AS unsupported, o_orderkey > 1 AND bit_count(o_orderkey) = 1 AS power FROM orders""")
def flag_mask(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", key.bitwiseAND(F.lit(65280)).cast("bigint").alias("codec_bits"), (key.bitwiseAND(F.lit(~8191)) != 0).alias("unsupported"), S.is_power_of_two(key).alias("power"))


@query("""SELECT o_orderkey, CASE (o_orderkey % 8 * 8192) & 61440 WHEN 32768 THEN 'f' WHEN 16384 THEN 'd' WHEN 40960 THEN 'l' WHEN 8192 THEN 'c' WHEN 24576 THEN 'b' WHEN 49152 THEN 's' WHEN 4096 THEN 'p' ELSE '?' END AS type,
  CASE WHEN o_custkey * 97 >= 65536 THEN 0 ELSE o_custkey * 97 END AS uid, (o_orderkey % 8 * 8192) | 365 AS mode, CASE WHEN o_custkey <> 0 THEN o_custkey ELSE o_orderkey + 1 END AS ino FROM orders""")
def inode_attributes(spark, sf_dir):
    mode = F.col("o_orderkey") % 8 * 8192
    return table(spark, sf_dir, "orders").select("o_orderkey", S.node_type(mode).alias("type"), S.narrow_id(F.col("o_custkey") * 97).alias("uid"), mode.bitwiseOR(F.lit(365)).alias("mode"), S.inode_number(F.col("o_custkey"), F.col("o_orderkey")).alias("ino"))


@query("""SELECT c.name, c.compiled, b.blksz, b.blksz IN (512, 4096, 131072, 1048576) AS quick FROM (VALUES ('zlib', 512, true), ('lz4', 4096, true), ('lzo', 4096, false), ('xz', 4096, true), ('zstd', 4096, true)) c(name, low, compiled)
CROSS JOIN (SELECT (1::BIGINT << s) AS blksz FROM generate_series(9, 20) t(s)) b WHERE b.blksz >= c.low""")
def pow2_blocksizes(spark, sf_dir):
    return codecs.block_sizes(codecs.codec_table(spark)).withColumn("quick", F.col("blksz").isin(512, 4096, 131072, 1048576))


@query("""SELECT o_orderkey, c.name AS codec, coalesce(c.compiled, false) AS usable FROM orders LEFT JOIN (VALUES (256, 'zlib', true), (512, 'lz4', true), (1024, 'lzo', false), (2048, 'xz', true), (4096, 'zstd', true)) c(id, name, compiled) ON (o_orderkey & 65280) = c.id""")
def codec_lookup(spark, sf_dir):
    known = codecs.codec_table(spark).select("id", F.col("name").alias("codec"), "compiled")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").bitwiseAND(F.lit(65280)).alias("flag"))
    return orders.join(F.broadcast(known), F.col("flag") == F.col("id"), "left").select("o_orderkey", "codec", F.coalesce("compiled", F.lit(False)).alias("usable"))  # five rows


#: A device table in its text form.
DEVICES = """# path type mode uid gid major minor start step count
/unit         d 711 3 4 - - - - -
/unit/memory  c 606 3 4 9 5 - - -

/unit/tape    b 620 3 4 21 0 0 2 4
/unit/port    c 602 3 4 33 7 2 1 5
/unit/clock   c 644 3 4 40 1 0 0 0
"""


@query("""SELECT path || CASE WHEN i IS NULL THEN '' ELSE i::VARCHAR END AS path, type, mode, major, CASE WHEN i IS NULL THEN minor ELSE major + i * step - start END AS minor FROM (
SELECT *, unnest(CASE WHEN cnt > start THEN generate_series(start, cnt - 1) WHEN cnt > 0 THEN [] ELSE [NULL]::BIGINT[] END) AS i FROM
(VALUES ('/unit', 'd', 457, 0, 0, 0, 0, 0), ('/unit/memory', 'c', 390, 9, 5, 0, 0, 0), ('/unit/tape', 'b', 400, 21, 0, 0, 2, 4), ('/unit/port', 'c', 386, 33, 7, 2, 1, 5), ('/unit/clock', 'c', 420, 40, 1, 0, 0, 0)) v(path, type, mode, major, minor, start, step, cnt))""")
def device_expand(spark, sf_dir):
    lines = spark.createDataFrame([(x,) for x in DEVICES.splitlines()], "value string")
    return devices.expand(devices.usable(devices.parse(lines))).select("path", "type", "mode", "major", "minor")


PATCH = """(SELECT s_suppkey + (CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1000000 END) AS k, s_nationkey + 100 AS nation FROM supplier)"""


@query(f"""SELECT coalesce(s.s_suppkey, p.k) AS s_suppkey, CASE WHEN p.k IS NOT NULL THEN p.nation ELSE s.s_nationkey END AS s_nationkey,
  CASE WHEN s.s_suppkey IS NOT NULL AND p.k IS NOT NULL THEN 'updated' WHEN s.s_suppkey IS NOT NULL THEN 'kept' ELSE 'inserted' END AS action FROM supplier s FULL JOIN {PATCH} p ON s.s_suppkey = p.k""")
def device_upsert(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    key = F.col("s_suppkey")
    patch = known.select((key + F.when(key % 3 == 0, 0).otherwise(1000000)).alias("s_suppkey"), (F.col("s_nationkey") + 100).alias("s_nationkey"))
    return devices.upsert(known, patch, ["s_suppkey"], ["s_nationkey"])


@query(f"""SELECT p.k AS s_suppkey, CASE WHEN s.s_suppkey IS NULL THEN 'missing' ELSE 'differs' END AS problem FROM {PATCH} p LEFT JOIN supplier s ON s.s_suppkey = p.k WHERE s.s_suppkey IS NULL OR s.s_nationkey IS DISTINCT FROM p.nation""")
def device_verify(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    key = F.col("s_suppkey")
    wanted = known.select((key + F.when(key % 3 == 0, 0).otherwise(1000000)).alias("s_suppkey"), (F.col("s_nationkey") + 100).alias("s_nationkey"))
    return devices.verify(wanted, known, "s_suppkey", ["s_nationkey"])


@query("""SELECT p_brand, p_partkey, p_name, coalesce(lag(p_name[1]) OVER (PARTITION BY p_brand ORDER BY p_partkey) <= p_name[1], true) AS ordered FROM part""")
def sort_order_check(spark, sf_dir):
    first = F.substring("p_name", 1, 1)
    before = ordered_lag(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand", "p_partkey"], F.struct("p_brand", first.alias("first")), "before")
    lower = (F.col("before")["p_brand"] == F.col("p_brand")) & (first < F.col("before")["first"])
    return before.select("p_brand", "p_partkey", "p_name", (~F.coalesce(lower, F.lit(False))).alias("ordered"))


@query("""SELECT l_partkey, count(*) AS n, min(l_extendedprice / l_quantity) = max(l_extendedprice / l_quantity) AS consistent, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY l_partkey""")
def shared_block_check(spark, sf_dir):
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), (F.min(unit) == F.max(unit)).alias("consistent"), F.countDistinct("l_suppkey").alias("n_suppliers"))


# --- traces and reports over events ------------------------------------------------------


@query("""SELECT count(*) AS accesses, sum(CASE WHEN p = user_id THEN 1 ELSE 0 END)::BIGINT AS hits FROM (SELECT user_id, lag(user_id) OVER (ORDER BY ts, event_id) AS p FROM events)""")
def cache_hits_1entry(spark, sf_dir):
    return traces.last_access_hits(table(spark, sf_dir, "events"), ["ts", "event_id"], "user_id")


@query("""SELECT count(*) AS accesses, sum(CASE WHEN p = w THEN 1 ELSE 0 END)::BIGINT AS hits FROM (SELECT w, lag(w) OVER (ORDER BY ts, event_id) AS p FROM (SELECT ts, event_id, user_id // 32 * 32 AS w FROM events))""")
def cache_hits_window(spark, sf_dir):
    aligned = table(spark, sf_dir, "events").withColumn("w", F.col("user_id").bitwiseAND(F.lit(~31)))
    return traces.last_access_hits(aligned, ["ts", "event_id"], "w")


@query("SELECT event_type, user_id % 16 AS slot, count(*) AS users, count(*) - 1 AS saved FROM events GROUP BY 1, 2")
def shared_state_users(spark, sf_dir):
    return traces.shared_users(table(spark, sf_dir, "events").withColumn("slot", F.col("user_id") % 16), ["event_type", "slot"])


@query("""SELECT event_id, user_id, sum(CASE WHEN event_type = 'view' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS live FROM events""")
def live_state_users(spark, sf_dir):
    changes = table(spark, sf_dir, "events").withColumn("delta", F.when(F.col("event_type") == "view", -1).otherwise(1))
    return traces.live_users(changes, "user_id", ["ts", "event_id"], "delta").select("event_id", "user_id", "live")


@query("""SELECT event_type AS name, user_id % 3 AS fstype, count(*) AS n, round_even(sum(value::DECIMAL(18,2))::DOUBLE / count(*), 4) AS avg_real FROM events GROUP BY 1, 2""")
def bench_report(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 3).alias("fstype"), F.col("value").cast("decimal(18,2)").alias("real"))
    return report.averages(log, ["name", "fstype"], ["real"])


@query("SELECT event_type AS name, " + ", ".join(f"round_even(sum(CASE WHEN user_id % 3 = {k} THEN value::DECIMAL(18,2) END)::DOUBLE / count(CASE WHEN user_id % 3 = {k} THEN 1 END), 4) AS avg_{k}" for k in range(3)) + " FROM events GROUP BY 1")
def bench_pivot(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 3).alias("fstype"), F.col("value").cast("decimal(18,2)").alias("real"))
    return report.pivoted(log, "name", "fstype", [0, 1, 2], "real")


@query("""SELECT event_id, (m * 60 + s)::DECIMAL(18,6)::DOUBLE AS seconds FROM (SELECT event_id, user_id::DECIMAL(18,6) AS m, value::DECIMAL(18,2)::DECIMAL(18,6) AS s FROM events)""")
def duration_parse(spark, sf_dir):
    text = F.concat_ws(":", F.col("user_id").cast("string"), F.col("value").cast("decimal(18,2)").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", S.seconds(text).cast("double").alias("seconds"))


@query("""SELECT event_id, 'b' || user_id AS codec, CASE WHEN user_id % 2 = 0 THEN event_type END AS mode FROM events""")
def option_parse(spark, sf_dir):
    text = F.concat(F.lit("codec=b"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(",mode="), F.col("event_type"))).otherwise(F.lit(",quiet")))
    found = S.options(text)
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(found, F.lit("codec")).alias("codec"), F.try_element_at(found, F.lit("mode")).alias("mode"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) - 1 AS place FROM part")
def seeded_shuffle(spark, sf_dir):
    keyed = table(spark, sf_dir, "part").select("p_partkey", F.md5(F.concat(F.lit("42:"), F.col("p_partkey").cast("string"))).alias("turn"))
    return ordered_total(keyed, ["turn", "p_partkey"], F.lit(1), "place").select("p_partkey", "place")


@query("SELECT l_returnflag, count(*) AS n, 0::BIGINT AS least, count(*) - 1 AS most, (count(*) * (count(*) - 1) // 2)::BIGINT AS total, count(*) AS n_distinct FROM lineitem GROUP BY l_returnflag")
def distributed_numbering(spark, sf_dir):
    """Gapless numbers within three hot groups; the order within a group is free, so its numbers are summed up."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    numbered = number_rows(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber"], "at", rows.count(), 3, per_bucket=5000)
    return numbered.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"), F.max("at").alias("most"), F.sum("at").alias("total"), F.countDistinct("at").alias("n_distinct"))


@query("SELECT doc_id, strlen(text)::BIGINT AS value, (strlen(text) % 256)::BIGINT AS low FROM documents")
def little_endian_fields(spark, sf_dir):
    size = S.size_of("text")
    hexed = F.lpad(F.hex(size), 8, "0")
    raw = F.unhex(F.concat(*(F.substring(hexed, k, 2) for k in (7, 5, 3, 1))))
    return table(spark, sf_dir, "documents").select("doc_id", S.little_endian(raw, 1, 4).alias("value"), S.little_endian(raw, 1, 1).alias("low"))


# --- codecs and containers ---------------------------------------------------------------


@query("SELECT c.name AS codec, count(*) AS n_blocks, sum(least(4096, strlen(text) - b * 4096))::BIGINT AS plain_bytes, 0::BIGINT AS n_bad FROM (SELECT text, unnest(generate_series(0, (strlen(text) - 1) // 4096)) AS b FROM documents WHERE strlen(text) > 0) CROSS JOIN (VALUES ('zlib'), ('lz4'), ('xz'), ('zstd')) c(name) GROUP BY c.name")
def codec_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), S.size_of("text").alias("size"))
    cut = layout.blocks(docs, 4096).select("blk_length", F.expr("substring(content, int(blk_offset) + 1, int(blk_length))").alias("plain"))
    out = None
    for name in ("zlib", "lz4", "xz", "zstd"):
        level = {"xz": 0, "zstd": 3}.get(name)
        back = cut.withColumn("back", codecs.decoded(codecs.encoded(F.col("plain"), name, level), F.col("blk_length"), name))
        one = back.agg(F.lit(name).alias("codec"), F.count(F.lit(1)).alias("n_blocks"), F.sum("blk_length").alias("plain_bytes"), F.sum((~F.col("back").eqNullSafe(F.col("plain"))).cast("bigint")).alias("n_bad"))
        out = one if out is None else out.unionByName(one)
    return out


def _container(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("content"))
    return files, container.build(files, "zlib", 4096)


@query("""WITH f AS (SELECT lang || '/' || source || '/' || doc_id AS name, text, strlen(text) AS size FROM documents), u AS (SELECT text, strlen(text) AS size FROM documents WHERE strlen(text) > 0 GROUP BY text)
SELECT (SELECT count(*) FROM f) AS n_entries, (SELECT sum(15 + strlen(name))::BIGINT FROM f) AS metadata_bytes, (SELECT sum(size)::BIGINT FROM f) AS plain_bytes, (SELECT sum((size + 4095) // 4096)::BIGINT FROM u) AS n_blocks""")
def image_totals(spark, sf_dir):
    return _container(spark, sf_dir)[1].totals().select("n_entries", "metadata_bytes", "plain_bytes", "n_blocks")


@query("SELECT lang || '/' || source || '/' || doc_id AS name, sha256(text) AS sha256, 0 AS n_violations FROM documents")
def image_build_check(spark, sf_dir):
    """Build a container, read every file back from its blocks, and count violations per file."""
    _, held = _container(spark, sf_dir)
    bad = container.violations(held).groupBy(F.col("name").alias("__bad")).count()
    files = container.read(held).select("name", F.sha2("content", 256).alias("sha256"))
    return files.join(bad, F.col("name") == F.col("__bad"), "left").select("name", "sha256", F.coalesce("count", F.lit(0)).cast("int").alias("n_violations"))


from lamella import tree_queries  # noqa: E402, F401 - adds its queries to those above
