"""Path expressions. A path is a string; its components are what slashes separate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def normalised(path: Column) -> Column:
    """Runs of slashes collapsed and the last one dropped, but for the root."""
    one = F.regexp_replace(path, "/+", "/")
    return F.when(one == "/", one).otherwise(F.regexp_replace(one, "/$", ""))


def appended(path: Column, part: Column) -> Column:
    return normalised(F.concat_ws("/", path, part))


def levels(path: Column) -> Column:
    """Components, and one for the root of an absolute path."""
    return F.size(components(path)) + path.startswith("/").cast("int")


def parent(path: Column) -> Column:
    """The path without its last component; the root's parent and a bare name's are empty."""
    clean = normalised(path)
    cut = F.regexp_replace(clean, "/?[^/]*$", "")
    return F.when((cut == "") & clean.startswith("/") & (clean != "/"), F.lit("/")).otherwise(cut)


def truncated(path: Column, level: int) -> Column:
    """The first ``level`` levels of the path."""
    clean = normalised(path)
    absolute = F.concat(F.lit("/"), F.array_join(F.slice(components(clean), 1, max(0, level - 1)), "/"))
    return F.when(clean.startswith("/"), absolute if level > 0 else F.lit("")).otherwise(F.array_join(F.slice(components(clean), 1, level), "/"))


def is_dot(name: Column) -> Column:
    return name.isin(".", "..")


def slug(path: Column) -> Column:
    return F.regexp_replace(path, "[^-a-zA-Z0-9]", "_")
