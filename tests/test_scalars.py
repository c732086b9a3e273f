"""Vectors of the scalar and path expressions."""

import pytest
from pyspark.sql import functions as F

from lamella.functions import paths as P
from lamella.functions import scalars as S


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_power_of_two(spark):
    got = values(spark, range(10), S.is_power_of_two(F.col("x")), "bigint")
    assert [i for i, v in enumerate(got) if v] == [2, 4, 8]


def test_blocks_needed(spark):
    assert values(spark, [0, 8, 64, 512, 768, 8192], S.blocks_needed(F.col("x"), 512), "bigint") == [0, 1, 1, 1, 2, 16]


@pytest.mark.parametrize(("n", "block", "want"), [(7, 1024, 1024), (5000, 4096, 8192), (8191, 8192, 8192), (0, 2048, 2048), (2048, 2048, 2048), (2049, 2048, 4096), ((1 << 53) + 1, 4096, (1 << 53) + 4096)])
def test_round_up(spark, n, block, want):
    assert values(spark, [n], S.round_up(F.col("x"), block), "bigint") == [want]


@pytest.mark.parametrize("n", [0, 1, 258, 70000, 305419896, 4026531840])
def test_little_endian(spark, n):
    assert values(spark, [n.to_bytes(4, "little")], S.little_endian(F.col("x"), 1, 4), "binary") == [n]


def test_node_type(spark):
    modes = [0o100644, 0o040755, 0o120777, 0o020640, 0o060640, 0o140600, 0o010600, 0]
    assert "".join(values(spark, modes, S.node_type(F.col("x")), "bigint")) == "fdlcbsp?"


def test_seconds(spark):
    got = values(spark, ["1.25", "2:03.5", "1:02:03", "x"], S.seconds(F.col("x")))
    assert [None if v is None else float(v) for v in got] == [1.25, 123.5, None, None]


def test_options(spark):
    assert values(spark, ["k=v,k2"], S.options(F.col("x"))) == [{"k": "v", "k2": None}]


def test_normalised(spark):
    assert values(spark, ["tmp////", "//", "/boot//grub///grub.cfg", "/", ""], P.normalised(F.col("x"))) == ["tmp", "/", "/boot/grub/grub.cfg", "/", ""]


def test_appended(spark):
    df = spark.createDataFrame([("/", "/dev"), ("/dev", "urandom"), ("boot", "/grub")], "a string, b string")
    assert [r[0] for r in df.select(P.appended(F.col("a"), F.col("b"))).collect()] == ["/dev", "/dev/urandom", "boot/grub"]


def test_parent_levels_dots(spark):
    assert values(spark, ["/dev", "/", "boot", "/etc/hosts"], P.parent(F.col("x"))) == ["/", "", "", "/etc"]
    assert values(spark, ["/etc/hosts", "/etc", "/", "", "etc/shadow"], P.levels(F.col("x"))) == [3, 2, 1, 0, 2]
    assert values(spark, [".", "..", "/", "./", ".dot", "..dotdot"], P.is_dot(F.col("x"))) == [True, True, False, False, False, False]
    assert values(spark, ["/a/b/c", "a/b/c"], P.truncated(F.col("x"), 2)) == ["/a", "a/b"]


def test_page_bytes(spark):
    df = spark.createDataFrame([(b"abcdefg", 0), (b"abcdefg", 1), (b"abcdefg", 2), (b"", 0)], "x binary, p bigint")
    assert [bytes(r[0]) for r in df.select(S.page_bytes(F.col("x"), F.col("p"), 4)).collect()] == [b"abcd", b"efg\0", b"\0" * 4, b"\0" * 4]


def test_xz_bound_holds(spark):
    import lzma
    import os

    for n in (0, 1, 65535, 65536, 65537, 300_000):
        raw = os.urandom(n)
        (bound,) = values(spark, [n], S.worst_case("xz", F.col("x")), "bigint")
        assert len(lzma.compress(raw, format=lzma.FORMAT_XZ, check=lzma.CHECK_CRC32)) <= bound
