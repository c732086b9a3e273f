"""Column expressions: block arithmetic, node attributes, little-endian fields, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File type bits of a mode and their letters.
TYPE_MASK = 0o170000
TYPE_LETTERS = {0o100000: "f", 0o040000: "d", 0o120000: "l", 0o020000: "c", 0o060000: "b", 0o140000: "s", 0o010000: "p"}


def size_of(column: str) -> Column:
    """Bytes of a text or binary column; 0 for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("bigint")


def is_power_of_two(n: Column) -> Column:
    """True for 2, 4, 8, ...; 1 is not taken as a power here."""
    return (n > 1) & (F.bit_count(n) == 1)


def blocks_needed(size: Column, block: int) -> Column:
    return F.when(size == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", size.cast("bigint") - 1, F.lit(block).cast("bigint")) + 1)


def round_up(size: Column, block: int) -> Column:
    """The next multiple of a power of two; one block for size 0."""
    return F.when(size == 0, F.lit(block)).otherwise((size - 1).bitwiseOR(F.lit(block - 1)) + 1).cast("bigint")


def shift_of(block: Column) -> Column:
    """log2 of a power of two, by its bit length."""
    return (F.length(F.bin(block.cast("bigint"))) - 1).cast("int")


def page_bytes(content: Column, page_nr: Column, page: int = 4096) -> Column:
    """A page of a binary column; what lies past its end is zero bytes."""
    return F.rpad(F.substring(content, (page_nr * page + 1).cast("int"), F.lit(page)), page, F.lit(b"\0"))


def node_type(mode: Column) -> Column:
    bits = mode.bitwiseAND(F.lit(TYPE_MASK))
    out = F.lit("?")
    for value, letter in TYPE_LETTERS.items():
        out = F.when(bits == value, letter).otherwise(out)
    return out


def narrow_id(xid: Column) -> Column:
    """A user or group id in 16 bits: 0 when it does not fit."""
    return F.when(xid >= 65536, 0).otherwise(xid)


def inode_number(data_offset: Column, entry_offset: Column) -> Column:
    return F.when(data_offset != 0, data_offset).otherwise(entry_offset + 1)


def little_endian(raw: Column, start: int, width: int) -> Column:
    """An unsigned little-endian field of a binary column (start from 1), as bigint."""
    pairs = [F.substring(F.hex(F.substring(raw, start + k, 1)), 1, 2) for k in reversed(range(width))]
    return F.conv(F.concat(*pairs), 16, 10).cast("bigint")


def little_endian_bytes(value: Column, width: int) -> Column:
    """A number of at most ``width`` bytes as a little-endian binary field; higher bits are cut."""
    hexed = F.lpad(F.hex(value.cast("bigint").bitwiseAND(F.lit((1 << 8 * width) - 1))), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(hexed, 2 * k + 1, 2) for k in reversed(range(width)))))


def device_number(major: Column, minor: Column) -> Column:
    """A device's number: 12 low bits of the major above 8 low bits of the minor, then the rest of both."""
    low = minor.bitwiseAND(F.lit(0xFF)).bitwiseOR(F.shiftleft(major.bitwiseAND(F.lit(0xFFF)), 8))
    return low.bitwiseOR(F.shiftleft(minor.bitwiseAND(F.lit(~0xFF)), 12)).bitwiseOR(F.shiftleft(major.bitwiseAND(F.lit(~0xFFF)), 32))


def device_major(number: Column) -> Column:
    return F.shiftright(number, 8).bitwiseAND(F.lit(0xFFF)).bitwiseOR(F.shiftrightunsigned(number, 32).bitwiseAND(F.lit(~0xFFF)))


def device_minor(number: Column) -> Column:
    return number.bitwiseAND(F.lit(0xFF)).bitwiseOR(F.shiftright(number, 12).bitwiseAND(F.lit(0xFFFFFF00)))


def strict_integer(text: Column) -> Column:
    """A decimal option value as bigint; an error for anything else. Blanks may lead."""
    plain = F.regexp_extract(text, r"^[\x20\x09-\x0D]*([+-]?[0-9]+)$", 1)
    return F.when(plain != "", plain.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("not an integer: "), F.coalesce(text, F.lit("null")))).cast("bigint"))


def range_draw(seed: Column, low: int, high: int) -> Column:
    """A number in [low, high] drawn by a hash of ``seed``; low numbers are ever so slightly likelier."""
    return F.pmod(seed, F.lit(high - low + 1)) + low


def padding_offset(padded: Column, padding: int = 512) -> Column:
    """Where the content begins: after the padding, if there is one."""
    return F.when(padded, F.lit(padding)).otherwise(F.lit(0))


def buffer_size(requested: Column, least: int, page: int = 4096) -> Column:
    """The buffer to use and whether the request was changed: the minimum when it asks for no more, else whole pages."""
    small = requested <= least
    return F.struct(F.when(small, F.lit(least)).otherwise(round_up(requested, page)).cast("bigint").alias("size"), (small | (requested % page != 0)).alias("changed"))


def quantised(x: Column, places: int = 4) -> Column:
    """Rounded half to even."""
    return F.bround(x, places)


def ratio_change(encoded: Column, plain: Column) -> Column:
    """By how many percent the encoded size differs from the plain one; null without bytes."""
    return F.when(plain > 0, (encoded - plain) * F.lit(100.0) / plain)


def octal(text: Column) -> Column:
    """An octal field; null when it is not one."""
    return F.when(text.rlike("^[0-7]+$"), F.conv(text, 8, 10).cast("bigint"))


def seconds(text: Column) -> Column:
    """``S.f`` or ``M:S.f`` as seconds in DECIMAL(18,6); null for any other form."""
    parts = F.split(text, ":")
    one = F.try_element_at(parts, F.lit(1)).try_cast("decimal(18,6)")
    two = F.try_element_at(parts, F.lit(2)).try_cast("decimal(18,6)")
    return F.when(F.size(parts) == 1, one).when(F.size(parts) == 2, (one * 60 + two).cast("decimal(18,6)"))


def options(text: Column) -> Column:
    """``k=v,k2`` as a map; a key without a value has null."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def worst_case(codec: str, n: Column) -> Column:
    """The largest encoded size of n bytes (the codecs' published bounds)."""
    if codec == "zlib":
        return n + F.shiftright(n, 12) + F.shiftright(n, 14) + F.shiftright(n, 25) + 13
    if codec == "lz4":
        return n + F.floor(n / 255) + 16
    if codec == "lzo":
        return n + F.floor(n / 16) + 67
    if codec == "zstd":
        return n + F.shiftright(n, 8) + F.when(n < 131072, F.shiftright(F.lit(131072) - n, 11)).otherwise(F.lit(0))
    if codec == "xz":
        chunks = F.call_function("div", n + 65535, F.lit(65536).cast("bigint"))  # three bytes a chunk, one at the end
        return (n + chunks * 3 + 1 + 3).bitwiseAND(F.lit(~3)) + 92 + 48  # headers of the block, and of the stream
    raise ValueError(codec)
