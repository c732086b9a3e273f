"""Device tables: parse, expand, apply to a tree, verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions.scalars import device_number, octal
from lamella.plans.numbering import ordered_total

FIELDS = ["path", "type", "mode", "uid", "gid", "major", "minor", "start", "incr", "count"]


#: The types that a table may have, and the mode of an entry without one.
TYPES = ("d", "f", "p", "c", "b")
DEFAULT_MODE = 0o755


def parse(lines: DataFrame, order: str | None = None) -> DataFrame:
    """Typed rows of device-table text (``value``); comments and blank lines are left out.

    Numbers stop counting at the first field that is none (``-``): that field and those
    after it keep their defaults (mode 0755, else 0). ``problem`` tells what makes a row
    unusable: a path that is not absolute, or a type that is not among ``TYPES``. With
    ``order`` (a column of ``lines``), ``line`` numbers the lines that count, from 1.
    """
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    kept = lines.withColumn("text", text).where((F.col("text") != "") & ~F.col("text").startswith("#"))
    if order:
        kept = ordered_total(kept.select("text", order), [order], F.lit(1), "line").withColumn("line", F.col("line") + 1)
    kept = kept.withColumn("f", F.split("text", " "))
    held: Column = F.lit(True)
    columns = [F.get("f", F.lit(0)).alias("path"), F.get("f", F.lit(1)).alias("type")]
    for k, name in enumerate(FIELDS[2:], 2):
        field = F.get("f", F.lit(k))
        number = octal(field) if name == "mode" else field.try_cast("bigint")
        held = held & number.isNotNull()
        columns.append(F.when(held, number).otherwise(F.lit(DEFAULT_MODE if name == "mode" else 0)).cast("bigint").alias(name))
    rows = kept.select(*columns, *(["line"] if order else []))
    problem = F.when(~F.col("path").startswith("/"), "relative path").when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "unsupported type")
    return rows.withColumn("problem", problem)


def usable(rows: DataFrame) -> DataFrame:
    """The parsed rows, without ``problem``; an error if any row has one."""
    told = F.concat_ws(" ", F.col("problem"), F.lit("of"), F.col("path"))
    return rows.withColumn("path", F.when(F.col("problem").isNull(), F.col("path")).otherwise(F.raise_error(told).cast("string"))).drop("problem")


def expand(rows: DataFrame, conventional: bool = False) -> DataFrame:
    """One row per node. A count makes nodes path||i for start <= i < count.

    The minor number is ``major + i * incr - start`` unless ``conventional``, where it is
    ``minor + (i - start) * incr`` as device tables elsewhere have it.
    """
    span = F.when(F.col("count") > F.col("start"), F.sequence(F.col("start"), F.col("count") - 1)).when(F.col("count") > 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(None).cast("bigint")))
    each = rows.withColumn("i", F.explode(span))
    usual = F.col("minor") + (F.col("i") - F.col("start")) * F.col("incr")
    table = F.col("major") + F.col("i") * F.col("incr") - F.col("start")
    return each.select(F.when(F.col("i").isNull(), F.col("path")).otherwise(F.concat("path", F.col("i").cast("string"))).alias("path"), "type", "mode", "uid", "gid", "major", F.when(F.col("i").isNull(), F.col("minor")).otherwise(usual if conventional else table).alias("minor"))


def fits_bits(bits: int) -> Column:
    """Whether the device number of ``major`` and ``minor`` fits so many bits."""
    return F.shiftrightunsigned(device_number(F.col("major"), F.col("minor")), bits) == 0


def nodes_of(devices: DataFrame) -> DataFrame:
    """path, type, mode, uid, gid, size (the device number; 0 for other types) of expanded rows."""
    number = F.when(F.col("type").isin("c", "b"), device_number(F.col("major"), F.col("minor"))).otherwise(F.lit(0))
    return devices.select("path", "type", "mode", "uid", "gid", number.cast("bigint").alias("size"))


def apply(tree: DataFrame, patch: DataFrame) -> DataFrame:
    """A tree (path, type, mode, uid, gid, size) with a device table's nodes: action and problem of each row.

    A node of the same path and type gets the patch's mode and ids (``updated``); any other is
    new (``inserted``), even beside a node of another type. Its parent must be a directory of
    the tree or of the table (``missing parent``), and a regular file can not be inserted
    (``file is not on disk``). Rows with a problem are not part of the tree.
    """
    mine = tree.select("path", "type", *(F.col(c).alias(f"__{c}") for c in ("mode", "uid", "gid", "size")), F.lit(True).alias("__known"))
    both = mine.join(patch.withColumn("__patch", F.lit(True)), ["path", "type"], "full_outer")
    known, other = F.col("__known").isNotNull(), F.col("__patch").isNotNull()
    values = [F.when(other, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in ("mode", "uid", "gid")]
    size = F.when(known, F.col("__size")).otherwise(F.col("size")).alias("size")
    action = F.when(known & other, "updated").when(known, "kept").otherwise("inserted").alias("action")
    rows = both.select("path", "type", *values, size, action).withColumn("__parent", F.regexp_replace("path", "/[^/]*$", ""))
    directories = tree.unionByName(patch).where("type = 'd'").select(F.col("path").alias("__dir")).distinct()
    placed = rows.join(directories, F.col("__parent") == F.col("__dir"), "left")
    new = F.col("action") == "inserted"
    problem = F.when(new & (F.col("__parent") != "") & F.col("__dir").isNull(), "missing parent").when(new & (F.col("type") == "f"), "file is not on disk")
    return placed.withColumn("problem", problem).drop("__parent", "__dir")


def upsert(tree: DataFrame, patch: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``tree`` with the patch's values where both have the key, and the patch's new rows."""
    left, right = tree.alias("t"), patch.alias("p")
    same = [F.col(f"t.{k}") == F.col(f"p.{k}") for k in key]
    known = F.col(f"t.{key[0]}").isNotNull()
    other = F.col(f"p.{key[0]}").isNotNull()
    return left.join(right, same, "full_outer").select(
        *(F.coalesce(f"t.{k}", f"p.{k}").alias(k) for k in key),
        *(F.when(other, F.col(f"p.{v}")).otherwise(F.col(f"t.{v}")).alias(v) for v in values),
        F.when(known & other, "updated").when(known, "kept").otherwise("inserted").alias("action"),
    )


def verify(expected: DataFrame, actual: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Expected rows that are missing or differ: key, problem."""
    found = actual.select(F.col(key).alias("__key"), *(F.col(v).alias(f"__{v}") for v in values))
    joined = expected.join(found, F.col(key) == F.col("__key"), "left")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.col(f"__{v}"))
    problem = F.when(F.col("__key").isNull(), "missing").when(differs, "differs")
    return joined.select(key, problem.alias("problem")).where("problem is not null")
