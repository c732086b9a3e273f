"""Queries of the node, device, codec and extraction operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import paths as P
from lamella.functions import scalars as S
from lamella.operators import devices, layout, nodes, report, tree
from lamella.plans.spool import spool, spool_path
from lamella.queries import query, table
from lamella.sources import codecs, container, extract, text_tables
from lamella.sources.directory import TreeSource

# --- nodes made of documents ------------------------------------------------------------------

#: Every document is a node; the last digit of its number tells its type, and some are not readable.
NODES = """nodes AS (SELECT doc_id, lang || '/' || doc_id AS path, doc_id::VARCHAR AS name,
  CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 10 < 5 THEN 'f' WHEN doc_id % 10 = 5 THEN 'l' WHEN doc_id % 10 = 6 THEN 'd' WHEN doc_id % 10 = 7 THEN 'c' WHEN doc_id % 10 = 8 THEN 's' ELSE 'p' END AS type,
  CASE WHEN doc_id % 13 = 0 OR strlen(text) IS NULL THEN 0 ELSE strlen(text) END::BIGINT AS size, doc_id % 7 <> 0 AS readable FROM documents)"""


def _nodes(spark, sf_dir) -> DataFrame:
    digit = F.col("doc_id") % 10
    kind = F.when(F.col("doc_id") % 97 == 0, F.lit(None)).when(digit < 5, "f").when(digit == 5, "l").when(digit == 6, "d").when(digit == 7, "c").when(digit == 8, "s").otherwise("p")
    size = F.when(F.col("doc_id") % 13 == 0, F.lit(0)).otherwise(S.size_of("text")).cast("bigint")
    name = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", name).alias("path"), name.alias("name"), kind.alias("type"), size.alias("size"), (F.col("doc_id") % 7 != 0).alias("readable"))


SKIPS = f"""{NODES}, marked AS (SELECT *, CASE WHEN type IS NULL THEN 'unknown' WHEN type IN ('f', 'l') AND NOT readable THEN 'unreadable' WHEN type IN ('f', 'l') AND size = 0 THEN 'empty' WHEN type = 's' THEN 'socket' END AS skip_reason FROM nodes)"""


@query(f"WITH {SKIPS} SELECT path, type, skip_reason FROM marked")
def node_skips(spark, sf_dir):
    return nodes.with_skip_reason(_nodes(spark, sf_dir)).select("path", "type", "skip_reason")


@query(f"""WITH {SKIPS} SELECT CASE WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN type = 'd' THEN 'directory' WHEN type IN ('f', 'l') THEN 'file' ELSE 'special' END AS class,
  count(*) AS n, sum(size)::BIGINT AS bytes FROM marked GROUP BY 1""")
def class_counts(spark, sf_dir):
    return nodes.class_counts(_nodes(spark, sf_dir))


@query(f"""WITH {SKIPS}, held AS (SELECT *, CASE WHEN type IN ('f', 'l') AND size > 0 THEN (size - 1) // 512 + 1 ELSE 0 END AS blocks FROM marked WHERE skip_reason IS NULL)
SELECT count(*) AS n_nodes, sum(CASE WHEN blocks > 0 THEN blocks + 1 ELSE 0 END)::BIGINT AS n_pointers, sum(CASE WHEN blocks > 0 THEN size ELSE 0 END)::BIGINT AS data_bytes,
  least(sum(15 + strlen(name) + CASE WHEN blocks > 0 THEN 4 * (blocks + 1) ELSE 0 END + blocks * (512 + 512 // 4096 + 512 // 16384 + 13)), 4294967296)::BIGINT AS upper_bound, count(*) > 65535 AS too_many FROM held""")
def node_bound(spark, sf_dir):
    return nodes.bound(nodes.with_skip_reason(_nodes(spark, sf_dir)).where("skip_reason is null"), "zlib", 512)


@query("""SELECT doc_id, strlen(text) * 524287 AS size, CASE WHEN strlen(text) * 524287 > 4294967295 THEN 'error' WHEN strlen(text) * 524287 > 16777215 THEN 'warning' ELSE 'ok' END AS verdict FROM documents""")
def file_size_verdicts(spark, sf_dir):
    """The limits are those of a stored file, so the texts' sizes are scaled to reach them."""
    size = S.size_of("text") * 524287
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), nodes.size_verdict(size).alias("verdict"))


@query("""WITH t AS (SELECT unnest(['all', l_returnflag]) AS parent, repeat('column' || l_linenumber, 60) AS name FROM lineitem)
SELECT parent, sum(15 + strlen(name))::BIGINT AS dir_bytes, CASE WHEN sum(15 + strlen(name)) > 16777215 THEN 'error' ELSE 'ok' END AS verdict FROM t GROUP BY parent""")
def directory_verdicts(spark, sf_dir):
    name = F.repeat(F.concat(F.lit("column"), F.col("l_linenumber").cast("string")), 60)
    return nodes.directory_verdicts(table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.lit("all"), F.col("l_returnflag"))).alias("parent"), name.alias("name")))


#: Records made of orders; many of them can not be.
RECORDS = """records AS (SELECT o_orderkey, 'r/' || o_orderkey AS path, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'n' || o_orderkey END AS name, CASE o_orderkey % 7 WHEN 0 THEN 'f' WHEN 1 THEN 'd' WHEN 2 THEN 'l' WHEN 3 THEN 'c' WHEN 4 THEN 'p' WHEN 5 THEN 's' ELSE '?' END AS type,
  CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 420 END AS mode, (o_custkey % 5)::BIGINT AS size, (o_orderkey * 40)::BIGINT AS entry_offset, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE (o_custkey % 90 + o_orderkey * 40) END::BIGINT AS data_offset FROM orders)"""


def _records(spark, sf_dir) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.element_at(F.array(*map(F.lit, "fdlcps?")), (key % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("r/"), key.cast("string")).alias("path"),
        F.when(key % 23 == 0, "").otherwise(F.concat(F.lit("n"), key.cast("string"))).alias("name"),
        kind.alias("type"),
        F.when(key % 29 == 0, 0).otherwise(420).alias("mode"),
        (customer % 5).cast("bigint").alias("size"),
        (key * 40).cast("bigint").alias("entry_offset"),
        F.when(customer % 3 == 0, F.lit(0)).otherwise(customer % 90 + key * 40).cast("bigint").alias("data_offset"),
    )


@query(f"""WITH {RECORDS}, r AS (SELECT *, entry_offset + 15 + strlen(name) AS past FROM records)
SELECT 'zero_mode' AS "check", path FROM r WHERE mode = 0 UNION ALL SELECT 'zero_name', path FROM r WHERE name = '' UNION ALL SELECT 'zero_size', path FROM r WHERE type IN ('f', 'l') AND size = 0
UNION ALL SELECT 'offset_in_record', path FROM r WHERE (type IN ('f', 'l') OR type = 'd' AND size > 0) AND data_offset < past UNION ALL SELECT 'special_offset', path FROM r WHERE type IN ('c', 'p', 's') AND data_offset <> 0
UNION ALL SELECT 'special_size', path FROM r WHERE type IN ('p', 's') AND size <> 0 UNION ALL SELECT 'unknown_type', path FROM r WHERE type = '?'""")
def record_checks(spark, sf_dir):
    return nodes.implausible(_records(spark, sf_dir))


@query(f"""WITH {RECORDS} SELECT path, CASE WHEN type IN ('f', 'l') AND data_offset <> 0 AND size > 0 THEN (size - 1) // 512 + 1 ELSE 0 END::BIGINT AS blocks_512, CASE WHEN type = 'c' THEN size ELSE -1 END AS device, entry_offset AS atime, entry_offset AS ctime FROM records""")
def node_attributes(spark, sf_dir):
    return nodes.attributes(_records(spark, sf_dir).withColumn("mtime", F.col("entry_offset"))).select("path", "blocks_512", F.coalesce("device", F.lit(-1)).alias("device"), "atime", "ctime")


# --- orders and neighbours -------------------------------------------------------------------

PLACED = "placed AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS start, (l_suppkey % 2)::BIGINT AS pointer_bytes, (l_quantity::BIGINT % 3) AS raw_bytes FROM lineitem)"


def _placed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("start"), (F.col("l_suppkey") % 2).cast("bigint").alias("pointer_bytes"), (F.col("l_quantity").cast("bigint") % 3).alias("raw_bytes"))


@query(f"""WITH {PLACED}, b AS (SELECT *, lag(start) OVER w AS s, lag(pointer_bytes) OVER w AS p, lag(raw_bytes) OVER w AS r FROM placed WINDOW w AS (ORDER BY start, id, pointer_bytes, raw_bytes))
SELECT id, start, coalesce(s = start, false) AS shared, coalesce(s = start, false) AND (p <> pointer_bytes OR r <> raw_bytes) AS strange FROM b""")
def adjacent_shares(spark, sf_dir):
    return layout.adjacent_shares(_placed(spark, sf_dir), "start", "id", "pointer_bytes", "raw_bytes").select("id", "start", "shared", "strange")


@query(f"""WITH {PLACED} SELECT start, count(*) AS n, count(DISTINCT (pointer_bytes, raw_bytes)) = 1 AS consistent, (sum(pointer_bytes) - min(pointer_bytes))::BIGINT AS saved_pointer_bytes, (sum(raw_bytes) - min(raw_bytes))::BIGINT AS saved_raw_bytes
FROM placed GROUP BY start HAVING count(*) > 1""")
def offset_shares(spark, sf_dir):
    return layout.shares(_placed(spark, sf_dir), "start", "pointer_bytes", "raw_bytes")


@query("""SELECT p_partkey, coalesce(lag(hex(encode(p_name))[1:2]) OVER (PARTITION BY p_brand ORDER BY p_partkey) <= hex(encode(p_name))[1:2], true) AS ordered FROM part""")
def name_order(spark, sf_dir):
    """The first byte of the names, in brands of any size."""
    return layout.disorder(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey", "p_name").select("p_partkey", "ordered")


@query("SELECT doc_id, strlen(text) AS size, row_number() OVER (ORDER BY strlen(text), doc_id) - 1 AS place FROM documents")
def size_order(spark, sf_dir):
    return nodes.by_size(table(spark, sf_dir, "documents").select("doc_id", S.size_of("text").alias("size")), "doc_id")


@query(f"WITH {PLACED} SELECT id, start, row_number() OVER (ORDER BY start, id) - 1 AS place FROM placed")
def offset_order(spark, sf_dir):
    from lamella.plans.numbering import ordered_total

    return ordered_total(_placed(spark, sf_dir).select("id", "start"), ["start", "id"], F.lit(1), "place")


@query(r"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^https?:/', ''), '/'), lambda x: x <> '') AS turn FROM pages)
SELECT page_id, row_number() OVER (ORDER BY turn, page_id) - 1 AS place FROM p""")
def pre_order(spark, sf_dir):
    """Paths with every directory just before what it holds."""
    from lamella.plans.numbering import ordered_total

    turn = P.components(F.regexp_replace("url", "^https?:/", "")).alias("turn")
    return ordered_total(table(spark, sf_dir, "pages").select("page_id", turn), ["turn", "page_id"], F.lit(1), "place").select("page_id", "place")


@query("SELECT * FROM (VALUES ('a', 2, 30::BIGINT), ('a/b', 1, 10::BIGINT), ('a/c', 1, 20::BIGINT)) t(path, n_leaves, total_bytes)")
def rollup_with_root(spark, sf_dir):
    """A path without components is below no node."""
    leaves = spark.createDataFrame([("/", 7), ("/a/b", 10), ("a//c", 20), ("", 5)], "path string, size bigint")
    return tree.subtree_totals(leaves, "path", "size").withColumn("n_leaves", F.col("n_leaves").cast("int"))


@query("SELECT rtrim(repeat('d/', i::INT), '/') AS path, i::INT AS depth FROM generate_series(1, 400) t(i)")
def deep_walk(spark, sf_dir):
    """A chain of 400 directories."""
    chain = spark.range(1, 401).select(F.expr("rtrim('/', repeat('d/', int(id)))").alias("path"), F.expr("rtrim('/', repeat('d/', int(id) - 1))").alias("parent"))
    return tree.walked(spark, spool(chain, "chain"))


@query("""WITH r AS (SELECT event_type AS name, user_id % 64 AS slot FROM events) SELECT name, slot, slot / 64 AS share, round_even(slot / 64, 4) AS even FROM r GROUP BY ALL""")
def half_even(spark, sf_dir):
    """Sixty-fourths, of which some lie half way between two numbers of four decimals."""
    slots = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 64).alias("slot")).distinct()
    share = F.col("slot") / 64
    return slots.select("name", "slot", share.alias("share"), S.quantised(share).alias("even"))


@query("""SELECT coalesce(l_returnflag, 'all') AS name, (sum(floor(l_extendedprice * (1 - l_discount))) - sum(floor(l_extendedprice))) * 100.0::DOUBLE / sum(floor(l_extendedprice)) AS change FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())""")
def size_change(spark, sf_dir):
    """By how much encoding changes sizes, by group and in total."""
    sizes = table(spark, sf_dir, "lineitem").select("l_returnflag", F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("bigint").alias("encoded"), F.floor("l_extendedprice").cast("bigint").alias("plain"))
    sums = sizes.rollup("l_returnflag").agg(F.sum("encoded").alias("encoded"), F.sum("plain").alias("plain"))
    return sums.select(F.coalesce("l_returnflag", F.lit("all")).alias("name"), S.ratio_change(F.col("encoded"), F.col("plain")).alias("change"))


# --- devices ---------------------------------------------------------------------------------

DEVICES = """# a board's nodes
/node            d  750  7  8  -  -  -  -  -

/node/zeroes     c  622  7  8  14 9  -  -  -
/node/disk       b  -    7  8  31 2  0  1  3
/node/line       c  604  0  2  25 0  4  2  7
  /node/queue    p  640  1  1
relative/node    c  600  0  0  1  1
/node/what       q  600  0  0  1  1
/nowhere/queue   p  600  0  0
/node/plain      f  600  0  0
"""


def _lines(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(DEVICES.splitlines())), "at bigint, value string")


@query("""SELECT * FROM (VALUES (1, '/node', 'd', 488, NULL), (2, '/node/zeroes', 'c', 402, NULL), (3, '/node/disk', 'b', 493, NULL), (4, '/node/line', 'c', 388, NULL), (5, '/node/queue', 'p', 416, NULL),
(6, 'relative/node', 'c', 384, 'relative path'), (7, '/node/what', 'q', 384, 'unsupported type'), (8, '/nowhere/queue', 'p', 384, NULL), (9, '/node/plain', 'f', 384, NULL)) t(line, path, type, mode, problem)""")
def device_lines(spark, sf_dir):
    """Lines that count are numbered; a mode that is not told is 0755; what can not be is told."""
    return devices.parse(_lines(spark), "at").select(F.col("line").cast("int").alias("line"), "path", "type", F.col("mode").cast("int").alias("mode"), "problem")


@query("""SELECT * FROM (VALUES ('/node', 'd', 'updated', NULL), ('/node/zeroes', 'c', 'updated', NULL), ('/node/zeroes', 'b', 'kept', NULL), ('/node/disk', 'b', 'inserted', NULL),
('/node/line4', 'c', 'inserted', NULL), ('/node/line5', 'c', 'inserted', NULL), ('/node/line6', 'c', 'inserted', NULL), ('/node/queue', 'p', 'inserted', NULL), ('/node/text', 'f', 'kept', NULL),
('/nowhere/queue', 'p', 'inserted', 'missing parent'), ('/node/plain', 'f', 'inserted', 'file is not on disk')) t(path, type, action, problem) ORDER BY path, type""")
def device_apply(spark, sf_dir):
    """A table's nodes match those of a tree by path and type; listed in their sort order."""
    held = [("/node", "d", 493, 0, 0, 0), ("/node/zeroes", "c", 493, 0, 0, 3), ("/node/zeroes", "b", 493, 0, 0, 3), ("/node/text", "f", 420, 0, 0, 10)]
    known = spark.createDataFrame(held, "path string, type string, mode bigint, uid bigint, gid bigint, size bigint")
    patch = devices.nodes_of(devices.expand(devices.parse(_lines(spark)).where("problem is null")))
    return devices.apply(known, patch).select("path", "type", "action", "problem").orderBy("path", "type")


@query("""WITH d AS (SELECT o_orderkey, (o_custkey % 5000)::BIGINT AS major, o_orderkey::BIGINT AS minor FROM orders), n AS (SELECT *, (minor & 255) | ((major & 4095) << 8) | ((minor & ~255::BIGINT) << 12) | ((major & ~4095::BIGINT) << 32) AS number FROM d)
SELECT o_orderkey, number, number < 65536 AS fits16, number >= 0 AND number < 4294967296 AS fits32 FROM n""")
def device_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5000).cast("bigint").alias("major"), F.col("o_orderkey").cast("bigint").alias("minor"))
    return rows.select("o_orderkey", S.device_number(F.col("major"), F.col("minor")).alias("number"), devices.fits_bits(16).alias("fits16"), devices.fits_bits(32).alias("fits32"))


@query("SELECT '/n' || n_nationkey AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'c' ELSE 'b' END AS type, 420 AS mode, n_nationkey::BIGINT AS major, n_regionkey::BIGINT AS minor FROM nation")
def device_table_round_trip(spark, sf_dir):
    """A device table written as text and read back."""
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("/n"), F.col("n_nationkey").cast("string")).alias("path"), F.when(F.col("n_nationkey") % 2 == 0, "c").otherwise("b").alias("type"), F.lit(420).alias("mode"), F.lit(0).alias("uid"), F.lit(0).alias("gid"), F.col("n_nationkey").alias("major"), F.col("n_regionkey").alias("minor"))
    path = spool_path(spark, "device-table")
    text_tables.write_device_table(rows, path)
    return devices.usable(text_tables.device_table(spark, path)).select("path", "type", F.col("mode").cast("int").alias("mode"), "major", "minor")


@query("SELECT url AS path FROM pages")
def path_list_round_trip(spark, sf_dir):
    path = spool_path(spark, "path-list")
    table(spark, sf_dir, "pages").select(F.concat("url", F.lit(" \t"))).write.text(path)
    return text_tables.path_list(spark, path)


# --- options, codecs, fields -----------------------------------------------------------------


@query("""SELECT o_orderkey, (o_custkey % 9000 <= 4096 OR o_custkey % 9000 % 4096 <> 0) AS changed, CASE WHEN o_custkey % 9000 <= 4096 THEN 4096 ELSE (o_custkey % 9000 + 4095) // 4096 * 4096 END::BIGINT AS buffer,
  CASE WHEN o_orderkey % 2 = 0 THEN 512 ELSE 0 END AS padding, ((o_custkey % 6 + 6) % 6 + 5)::BIGINT AS drawn, o_orderkey::BIGINT AS number FROM orders""")
def option_values(spark, sf_dir):
    requested = F.col("o_custkey") % 9000
    buffer = S.buffer_size(requested, 4096)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        buffer["changed"].alias("changed"),
        buffer["size"].alias("buffer"),
        S.padding_offset(F.col("o_orderkey") % 2 == 0).alias("padding"),
        S.range_draw(F.col("o_custkey").cast("bigint"), 5, 10).alias("drawn"),
        S.strict_integer(F.concat(F.lit(" +"), F.col("o_orderkey").cast("string"))).alias("number"),
    )


@query("""SELECT name, 'plain' AS kind FROM (SELECT DISTINCT l_returnflag AS name FROM lineitem) UNION ALL SELECT name || ',pad', 'padded' FROM (SELECT DISTINCT l_returnflag AS name FROM lineitem)""")
def padded_variants(spark, sf_dir):
    """A list of options, and each of them again with padding."""
    plain = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name")).distinct()
    return plain.withColumn("kind", F.lit("plain")).unionByName(plain.select(F.concat("name", F.lit(",pad")).alias("name"), F.lit("padded").alias("kind")))


@query("""WITH w AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'zlib' WHEN 1 THEN 'lz4' WHEN 2 THEN 'lzo' WHEN 3 THEN 'xz' WHEN 4 THEN 'zstd' ELSE 'none' END AS name, (1 << (o_custkey % 14 + 8)::INT)::BIGINT AS blksz FROM orders),
c(id, name, low, compiled) AS (VALUES (256, 'zlib', 512, true), (512, 'lz4', 4096, true), (1024, 'lzo', 4096, false), (2048, 'xz', 4096, true), (4096, 'zstd', 4096, true))
SELECT o_orderkey, w.name, blksz, coalesce(c.id, 0) AS id, CASE WHEN c.name IS NULL THEN 'unknown' WHEN NOT compiled THEN 'not available' WHEN blksz < low OR blksz > 1048576 THEN 'block size' END AS problem FROM w LEFT JOIN c ON c.name = w.name""")
def codec_usable(spark, sf_dir):
    names = F.array(*map(F.lit, ("zlib", "lz4", "lzo", "xz", "zstd", "none")))
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("name"), F.expr("shiftleft(1L, int(o_custkey % 14 + 8))").alias("blksz"))
    return codecs.usable(codecs.codec_table(spark), wanted).withColumn("id", F.coalesce("id", F.lit(0)))


@query("SELECT 256 AS id, 'zlib' AS name")
def first_codec(spark, sf_dir):
    return codecs.first_available(codecs.codec_table(spark)).select("id", "name")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'length' WHEN o_orderkey % 3 = 0 THEN 'magic' WHEN o_custkey * 8 < 4096 THEN 'dictionary' END AS problem FROM orders""")
def codec_data_checks(spark, sf_dir):
    magic = S.little_endian_bytes(F.when(F.col("o_orderkey") % 3 == 0, F.lit(7)).otherwise(F.lit(codecs.XZ_MAGIC)), 4)
    data = F.concat(magic, S.little_endian_bytes(F.col("o_custkey") * 8, 4))
    return table(spark, sf_dir, "orders").select("o_orderkey", codecs.xz_data_problem(F.when(F.col("o_orderkey") % 5 == 0, F.substring(data, 1, 7)).otherwise(data)).alias("problem"))


@query("SELECT o_orderkey, (o_orderkey * 70001) & 4294967295 AS four, (o_orderkey * 70001) & 16777215 AS three FROM orders")
def little_endian_round_trip(spark, sf_dir):
    value = F.col("o_orderkey").cast("bigint") * 70001
    return table(spark, sf_dir, "orders").select("o_orderkey", S.little_endian(S.little_endian_bytes(value, 4), 1, 4).alias("four"), S.little_endian(S.little_endian_bytes(value, 3), 1, 3).alias("three"))


@query(r"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^https?:/', ''), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, '/' || array_to_string(parts[1:1], '/') AS two, parts[len(parts)] IN ('.', '..') AS dot FROM p""")
def path_truncate(spark, sf_dir):
    path = F.regexp_replace("url", "^https?:/", "")
    return table(spark, sf_dir, "pages").select("page_id", P.truncated(path, 2).alias("two"), P.is_dot(F.element_at(P.components(path), -1)).alias("dot"))


# --- containers ------------------------------------------------------------------------------


def _same_names(spark) -> container.Container:
    files = [("a", "x" * 5000), ("a", "y" * 6000), ("b", "x" * 5000), ("c", "")]
    return container.build(spark.createDataFrame(files, "name string, content string"), "zlib", 4096)


@query("SELECT name, sha256(content) AS sha256 FROM (VALUES ('a', repeat('x', 5000)), ('a', repeat('y', 6000)), ('b', repeat('x', 5000)), ('c', '')) t(name, content)")
def repeated_names(spark, sf_dir):
    """Two files of one name keep their own content."""
    return container.read(_same_names(spark)).select("name", F.sha2("content", 256).alias("sha256"))


@query("""SELECT * FROM (VALUES ('decode', 'a'), ('decode', 'b'), ('size', 'a'), ('size', 'b'), ('offset', 'a'), ('zero_name', ''), ('empty_block', 'a')) t("check", name)""")
def damaged_container(spark, sf_dir):
    """What the checks tell of a container with a broken block, an emptied one, a lost offset and a lost name."""
    held = _same_names(spark)
    x, y = (F.sha2(F.lit(c * n), 256) for c, n in (("x", 5000), ("y", 6000)))
    payload = F.when((F.col("digest") == x) & (F.col("blk_nr") == 1), F.lit(b"broken")).otherwise(F.col("payload"))
    length = F.when((F.col("digest") == y) & (F.col("blk_nr") == 0), F.lit(0)).otherwise(F.col("length"))
    held.blocks = held.blocks.withColumn("payload", payload).withColumn("length", length.cast("bigint"))
    lost = F.when(F.col("digest") == y, F.lit(None)).otherwise(F.col("data_offset"))
    held.entries = held.entries.withColumn("data_offset", lost).withColumn("name", F.when(F.col("name") == "c", "").otherwise(F.col("name")))
    return container.violations(held).select("check", "name")


@query("""WITH f AS (SELECT text, strlen(text)::BIGINT AS size FROM documents WHERE strlen(text) > 0 GROUP BY text) SELECT sha256(text) AS digest, (size + 4095) // 4096 AS n_blocks, size AS plain_bytes, 0::BIGINT AS n_bad, true AS within FROM f""")
def decode_totals(spark, sf_dir):
    """Blocks, bytes and failures of every stored content, block by block, and whether each block is within the bound."""
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("content"))
    found = container.decode_totals(container.build(files, "zlib", 4096))
    most = S.worst_case("zlib", F.lit(4096).cast("bigint"))
    return found.select("digest", "n_blocks", "plain_bytes", "n_bad", ((F.col("least") > 0) & (F.col("most") <= most) & (F.col("raw_bytes") > 0)).alias("within"))


@query("""WITH f AS (SELECT doc_id, lang, text FROM documents) SELECT lang || '/' || doc_id AS path, 'f' AS type, 416 AS mode, strlen(text) AS size, NULL AS target FROM f WHERE strlen(text) > 0
UNION ALL SELECT lang || '/' || doc_id || '.link', 'l', 511, strlen(doc_id::VARCHAR), doc_id::VARCHAR FROM f WHERE doc_id % 100 = 0 UNION ALL SELECT DISTINCT lang, 'd', 488, 0, NULL FROM f""")
def extract_and_scan(spark, sf_dir):
    """A tree written to the shared folder block by block, with links, modes and times, and scanned again."""
    docs = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"))
    held = container.build(docs.select(F.concat_ws("/", "lang", "name").alias("name"), "content"), "lz4", 4096)
    files = held.entries.where("size > 0").select(F.col("name").alias("path"), F.lit("f").alias("type"), F.lit(0o640).alias("mode"), "size", F.lit(None).cast("string").alias("target"), F.col("digest").alias("key"))
    links = docs.where("name % 100 = 0").select(F.concat("lang", F.lit("/"), "name", F.lit(".link")).alias("path"), F.lit("l").alias("type"), F.lit(0o777).alias("mode"), F.lit(0).cast("bigint").alias("size"), F.col("name").alias("target"), F.lit(None).cast("string").alias("key"))
    folders = docs.select(F.col("lang").alias("path"), F.lit("d").alias("type"), F.lit(0o750).alias("mode"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("key")).distinct()
    all_nodes = spool(files.unionByName(links).unionByName(folders).select("*", F.lit(0).alias("uid"), F.lit(0).alias("gid"), F.lit(1_000_000_000).alias("mtime")), "extract-nodes")
    root = extract.local_path(spool_path(spark, "extract"))
    extract.extract(all_nodes, container.plain_blocks(held).select(F.col("digest").alias("key"), "blk_offset", "plain"), root)
    spark.dataSource.register(TreeSource)
    found = spark.read.format("tree").option("path", root).load()
    return found.select("path", "type", F.col("mode").bitwiseAND(F.lit(0o777)).alias("mode"), F.when(F.col("type") != "d", F.col("size")).otherwise(F.lit(0)).alias("size"), "target")


@query("""SELECT 'n_entries' AS field, 4 AS counted, 3 AS told UNION ALL SELECT 'plain_bytes', 16000, 10000""")
def totals_check(spark, sf_dir):
    """A container whose totals were stored before its last file came."""
    held = _same_names(spark)
    stored = held.totals().withColumn("n_entries", F.col("n_entries") - 1).withColumn("plain_bytes", F.col("plain_bytes") - 6000)
    found = container.totals_problem(held, stored)
    return found.select("field", F.col("counted").cast("int").alias("counted"), F.col("told").cast("int").alias("told"))


@query("""WITH p AS (SELECT doc_id, strlen(text) AS size, unnest(generate_series(0, strlen(text) // 1024 + 1)) AS page_nr FROM documents)
SELECT doc_id, page_nr, 1024 AS length, 1024 - greatest(0, least(1024, size - page_nr * 1024)) AS zeros FROM p""")
def page_fill(spark, sf_dir):
    """The pages of every text and one past its end, which is all zeros."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    last = F.call_function("div", F.octet_length("content"), F.lit(1024)) + 1
    pages = docs.select("doc_id", "content", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("page_nr")).withColumn("page", S.page_bytes(F.col("content"), F.col("page_nr"), 1024))
    zeros = F.call_function("div", F.length(F.regexp_extract(F.hex("page"), "(?:00)*$", 0)), F.lit(2))
    return pages.select("doc_id", "page_nr", F.octet_length("page").alias("length"), zeros.alias("zeros"))


@query("""SELECT doc_id, ((n + (n + 65535) // 65536 * 3 + 1 + 3) // 4 * 4 + 140)::BIGINT AS bound FROM (SELECT doc_id, strlen(text)::BIGINT AS n FROM documents)""")
def xz_bound(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.worst_case("xz", S.size_of("text")).alias("bound"))


@query("""SELECT event_type AS name, (user_id % 3)::VARCHAR AS fstype, count(*) AS n, sum(60 + (value::DECIMAL(18,2))::DECIMAL(18,6))::DOUBLE AS real FROM events GROUP BY 1, 2""")
def bench_log_round_trip(spark, sf_dir):
    """A benchmark log written as text, durations in minutes and seconds, and read back."""
    path = spool_path(spark, "bench-log")
    events = table(spark, sf_dir, "events")
    real = F.concat(F.lit("1:"), F.col("value").cast("decimal(18,2)").cast("string"))
    events.select((F.col("user_id") % 3).cast("string").alias("fstype"), F.col("event_type").alias("name"), F.lit("ls").alias("cmd"), real.alias("real"), F.lit("0").alias("user"), F.lit("0").alias("sys")).write.csv(path)
    log = text_tables.bench_log(spark, path)
    return log.groupBy("name", "fstype").agg(F.count(F.lit(1)).alias("n"), F.sum("real").cast("double").alias("real"))
