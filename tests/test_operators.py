"""Operators against plain Python on small inputs."""

import os

import pytest
from pyspark.sql import functions as F

from lamella.functions import scalars
from lamella.operators import devices, layout, traces, tree
from lamella.plans import number_rows, ordered_lag, ordered_total
from lamella.plans.spool import scratch, spool_path
from lamella.queries import DEVICES
from lamella.sources import codecs, container, extract, text_tables
from lamella.sources.directory import TreeSource


def test_number_rows_in_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("g"))
    got = number_rows(df, ["g"], ["id"], "n", 3000, 2, per_bucket=100).collect()
    for g in (0, 1):
        assert sorted(r.n for r in got if r.g == g) == list(range(2000 if g == 0 else 1000))


def test_ordered_total(spark):
    df = spark.createDataFrame([(i * 7919 % 500, i) for i in range(500)], "k bigint, v bigint")
    got = {r.k: r.at for r in ordered_total(df, ["k"], F.col("v"), "at", 5).collect()}
    at = 0
    for k, v in sorted((i * 7919 % 500, i) for i in range(500)):
        assert got[k] == at
        at += v


def test_ordered_total_of_nothing(spark):
    assert ordered_total(spark.createDataFrame([], "k bigint, v bigint"), ["k"], F.col("v"), "at").count() == 0


def test_walk_of_a_deep_tree(spark):
    deep = [("/".join(["d"] * n), "/".join(["d"] * (n - 1))) for n in range(1, 151)]
    rows = [*deep, ("wide", ""), ("lost/x", "lost"), ("lost/x/y", "lost/x"), ("loop", "round"), ("round", "loop")]
    got = tree.walked(spark, spark.createDataFrame(rows, "path string, parent string")).collect()
    assert sorted((r.path, r.depth) for r in got) == sorted([*((p, n) for n, (p, _) in enumerate(deep, 1)), ("wide", 1)])
    assert tree.walked(spark, spark.createDataFrame([], "path string, parent string")).count() == 0


def test_walk_passes_the_recursion_limits(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        rows = [(f"n{i}", "" if i < 20 else f"n{i % 20}") for i in range(60)]
        got = tree.walked(spark, spark.createDataFrame(rows, "path string, parent string")).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sorted((r.path, r.depth) for r in got) == sorted((p, 1 if not up else 2) for p, up in rows)


def test_smallest_real_encoding(spark):
    import struct

    from lamella.operators import report
    from lamella.queries import CHOICES

    calls = b"".join(b"\xe8" + struct.pack("<i", 90000 - 5 * i) for i in range(800))
    blocks = [b"x", b"ab" * 2000, bytes(range(256)) * 16, os.urandom(900), calls, b"the same words again " * 40]
    rows = spark.createDataFrame(list(enumerate(blocks)), "k bigint, plain binary")
    got = {r.k: (r.best_length, r.best) for r in report.smallest(codecs.candidates(rows, "k", "plain", CHOICES), "k", "codec", "len", "ord").collect()}
    for k, raw in enumerate(blocks):
        lengths = [len(codecs._encoder(name, level)(raw)) for name, level in CHOICES]
        assert got[k] == (min(lengths), CHOICES[lengths.index(min(lengths))][0])
    assert got[4][1] == "xz+x86" and len({best for _, best in got.values()}) > 2
    for name, level in CHOICES:
        back = rows.select(F.col("plain").eqNullSafe(codecs.decoded(codecs.encoded(F.col("plain"), name, level), F.octet_length("plain"), name)).alias("same"))
        assert all(r.same for r in back.collect())


def test_device_table(spark):
    lines = spark.createDataFrame([(x,) for x in DEVICES.splitlines()], "value string")
    rows = devices.parse(lines)
    assert rows.count() == 5
    paths = sorted(r.path for r in devices.expand(rows).collect())
    assert paths == ["/unit", "/unit/clock", "/unit/memory", "/unit/port2", "/unit/port3", "/unit/port4", "/unit/tape0", "/unit/tape1", "/unit/tape2", "/unit/tape3"]
    usual = {r.path: r.minor for r in devices.expand(rows, conventional=True).collect()}
    assert usual["/unit/tape3"] == 6 and usual["/unit/port2"] == 7


def test_unusable_device_lines_are_errors(spark):
    for line in ("unit c 600 0 0 1 1", "/unit q 600 0 0 1 1"):
        rows = devices.parse(spark.createDataFrame([(line,)], "value string"))
        with pytest.raises(Exception, match="relative path|unsupported type"):
            devices.usable(rows).collect()


def test_a_directory_as_a_device_table(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "f").write_text("left out")
    os.mkfifo(tmp_path / "in" / "d" / "p", 0o622)
    os.chmod(tmp_path / "in" / "d" / "p", 0o622)
    os.chmod(tmp_path / "in" / "d", 0o711)
    text_tables.write_device_table(text_tables.directory_table(spark, str(tmp_path / "in")), str(tmp_path / "table"))
    got = {(r.path, r.type, r.mode, r.uid) for r in devices.usable(text_tables.device_table(spark, str(tmp_path / "table"))).collect()}
    assert got == {("/d", "d", 0o711, os.getuid()), ("/d/p", "p", 0o622, os.getuid())}


@pytest.mark.parametrize(("major", "minor"), [(1, 3), (1, 300), (4095, 255), (4096, 0), (259, 1 << 20)])
def test_device_numbers(spark, major, minor):
    row = spark.createDataFrame([(major, minor)], "major bigint, minor bigint").select(scalars.device_number(F.col("major"), F.col("minor")).alias("n"), devices.fits_bits(16).alias("fits")).first()
    again = spark.createDataFrame([(row.n,)], "n bigint").select(scalars.device_major(F.col("n")), scalars.device_minor(F.col("n"))).first()
    assert again[:] == (major, minor)
    assert row.n == os.makedev(major, minor) and row.fits == (os.makedev(major, minor) < 1 << 16)


def test_extraction(spark, tmp_path):
    files = [("a/b", "x" * 1000), ("a/c", "yz" * 700), ("a/d", "x" * 1000)]
    held = container.build(spark.createDataFrame(files, "name string, content string"), "zlib", 512)
    schema = "path string, type string, mode int, uid int, gid int, mtime bigint, size bigint, target string, key string"
    me = (os.getuid(), os.getgid())
    entries = [(r.name, "f", 0o640, *me, 10**9, r.size, None, r.digest) for r in held.entries.collect()]
    nodes = [*entries, ("a", "d", 0o750, *me, 10**9, 0, None, None), ("a/l", "l", 0o777, *me, 10**9, 1, "b", None), ("a/p", "p", 0o600, *me, 10**9, 0, None, None), ("a/s", "s", 0o600, *me, 10**9, 0, None, None)]
    blocks = container.plain_blocks(held).select(F.col("digest").alias("key"), "blk_offset", "plain")
    for _ in range(2):  # every step may be repeated
        done = {r.path: r.done for r in extract.extract(spark.createDataFrame(nodes, schema), blocks, str(tmp_path), owner=True, pipes=True).collect()}
    assert done == {"a": "directory", "a/b": "written", "a/c": "written", "a/d": "written", "a/l": "linked", "a/p": "made", "a/s": "told"}
    for name, content in files:
        assert (tmp_path / name).read_text() == content
        assert (tmp_path / name).stat().st_mode & 0o777 == 0o640 and (tmp_path / name).stat().st_mtime == 10**9
    assert os.readlink(tmp_path / "a" / "l") == "b" and (tmp_path / "a").stat().st_mode & 0o777 == 0o750
    outside = spark.createDataFrame([("../x", "f", 0o640, 0, 0, 0, 1, None, "k")], schema)
    with pytest.raises(Exception, match="not a path below"):
        extract.extract(outside, blocks, str(tmp_path)).collect()


def test_strict_integers(spark):
    got = spark.createDataFrame([(" 12",), ("-3",), ("+7",)], "x string").select(scalars.strict_integer(F.col("x"))).collect()
    assert [r[0] for r in got] == [12, -3, 7]
    for bad in ("12 ", "x", "", "1.0"):
        with pytest.raises(Exception, match="not an integer"):
            spark.createDataFrame([(bad,)], "x string").select(scalars.strict_integer(F.col("x"))).collect()


def test_scratch_is_deleted(spark):
    with scratch(spark):
        path = spool_path(spark, "t")
        spark.range(3).write.parquet(path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
    assert "scratch" not in spool_path(spark, "t")


def test_ordered_lag(spark):
    df = spark.createDataFrame([(i * 7919 % 500, i) for i in range(500)], "k bigint, v bigint")
    got = {r.k: r.before for r in ordered_lag(df, ["k"], F.col("v"), "before").collect()}
    order = sorted((i * 7919 % 500, i) for i in range(500))
    assert got == {k: (order[j - 1][1] if j else None) for j, (k, _) in enumerate(order)}


def test_upsert_and_verify(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, mode int")
    new = spark.createDataFrame([("b", 5), ("c", 7)], "path string, mode int")
    got = {r.path: (r["mode"], r.action) for r in devices.upsert(old, new, ["path"], ["mode"]).collect()}
    assert got == {"a": (1, "kept"), "b": (5, "updated"), "c": (7, "inserted")}
    assert {(r.path, r.problem) for r in devices.verify(new, old, "path", ["mode"]).collect()} == {("b", "differs"), ("c", "missing")}


def test_last_access_hits_across_ranges(spark):
    keys = [1, 1, 2, 2, 2, 3, 1, 1]
    df = spark.createDataFrame(list(enumerate(keys)), "t int, k int")
    assert traces.last_access_hits(df, ["t"], "k").first()[:] == (8, 4)


def test_tree_diff(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted((r.x, r.side) for r in tree.differences(a, b).collect()) == [(1, "left"), (2, "left"), (3, "right")]


def test_covering_blocks(spark):
    pages = spark.createDataFrame([(0,), (3,)], "page_nr bigint")
    assert sorted(r[:] for r in layout.covering_blocks(pages, 4096, 2048).collect()) == [(0, 0), (0, 1), (3, 6), (3, 7)]
    assert sorted(r[:] for r in layout.covering_blocks(pages, 4096, 16384).collect()) == [(0, 0), (3, 0)]


def test_container_round_trip_and_corruption(spark):
    files = [("a", "x" * 1000), ("b", "x" * 1000), ("c", ""), ("d", "yz" * 700), ("ü", "é")]
    held = container.build(spark.createDataFrame(files, "name string, content string"), "zlib", 512)
    assert {r.name: bytes(r.content).decode() for r in container.read(held).collect()} == dict(files)
    assert container.violations(held).count() == 0
    entries = {r.name: r for r in held.entries.collect()}
    assert entries["a"].data_offset == entries["b"].data_offset and entries["c"].data_offset is None
    broken = held.blocks.withColumn("payload", F.when(F.col("leader") == "d", F.lit(b"broken")).otherwise(F.col("payload")))
    held.blocks = broken
    assert {r.check for r in container.violations(held).where("name = 'd'").collect()} == {"decode", "size"}
    assert container.violations(held).where("name = 'a'").count() == 0


def test_tree_source(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "f").write_text("hello")
    (tmp_path / "empty").write_text("")
    os.symlink("d/f", tmp_path / "link")
    spark.dataSource.register(TreeSource)
    got = {r.path: r for r in spark.read.format("tree").option("path", str(tmp_path)).load().collect()}
    assert {p: r.type for p, r in got.items()} == {"d": "d", "d/e": "d", "d/f": "f", "empty": "f", "link": "l"}
    assert got["empty"].skip_reason == "empty" and got["link"].target == "d/f" and got["d/f"].size == 5


def test_text_tables(spark, tmp_path):
    (tmp_path / "paths").write_text("a/b  \n\n c\t\n")
    assert [r[0] for r in text_tables.path_list(spark, str(tmp_path / "paths")).collect()] == ["a/b", " c"]
    (tmp_path / "log.csv").write_text("x,0: list,ls,1.5,0:01.25,2\n")
    row = text_tables.bench_log(spark, str(tmp_path / "log.csv")).first()
    assert [float(v) for v in row[3:]] == [1.5, 1.25, 2.0]


def test_windowed_report(spark, tmp_path):
    from lamella.streaming.events import windowed_report

    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:10:00' AS ts, 'view' AS event_type, 2.0D AS value UNION ALL SELECT timestamp_ntz'2024-01-01 00:20:00', 'view', 3.0D")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_report(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    run.processAllAvailable()
    run.stop()
    assert [(r.n, float(r.total)) for r in spark.sql("SELECT * FROM windowed").collect()] == [(2, 5.0)]
