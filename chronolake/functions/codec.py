"""Scalars and codecs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u64_hex(x: Column) -> Column:
    """A whole number as 16 hex digits, big endian: text that sorts like the number (from 0 on)."""
    return F.lpad(F.lower(F.hex(x.cast("bigint"))), 16, "0")


def u64_bytes(x: Column) -> Column:
    """A whole number as 8 bytes, big endian."""
    return F.unhex(u64_hex(x))


def u64_from_bytes(b: Column) -> Column:
    """The number of up to 8 bytes, big endian, as decimal(20,0): it may exceed a signed 64-bit number."""
    return F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")


def hex_encode(b: Column) -> Column:
    """0x and lower-case digits; NULL stays NULL."""
    return F.concat(F.lit("0x"), F.lower(F.hex(b)))


def has_0x(s: Column) -> Column:
    return F.lower(F.substring(s, 1, 2)) == "0x"


def is_hex(s: Column) -> Column:
    """Digits of hex, an even number of them; empty text isn't."""
    return s.rlike("^([0-9a-fA-F]{2})+$")


def hex_decode(s: Column) -> Column:
    """Bytes of hex text with or without 0x; NULL if it isn't hex."""
    digits = F.when(has_0x(s), F.substring(s, 3, 1 << 30)).otherwise(s)
    return F.when(is_hex(digits), F.unhex(digits))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def safe_add(a: Column, b: Column) -> Column:
    """The sum of unsigned 64-bit numbers, NULL on overflow. Inputs as decimal(20,0)."""
    s = a.cast("decimal(38,0)") + b.cast("decimal(38,0)")
    return F.when(s <= F.lit("18446744073709551615").cast("decimal(38,0)"), s.cast("decimal(20,0)"))


def safe_mul(a: Column, b: Column) -> Column:
    """The product of unsigned 64-bit numbers, NULL on overflow."""
    top = F.lit("18446744073709551615").cast("decimal(20,0)")
    x, y = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    fits = (y == 0) | (x <= F.floor(top / F.when(y == 0, 1).otherwise(y)))
    return F.when(fits, F.try_multiply(x.cast("decimal(20,0)"), y.cast("decimal(18,0)")).cast("decimal(20,0)"))


def byte_count(n: Column) -> Column:
    """A number of bytes for reading: 1024-based, one decimal, halves to the even digit."""
    out = F.when(n < 1024, F.format_string("%d B", n.cast("bigint")))
    for i, unit in enumerate("KMGTPE"):
        size = 1024.0 ** (i + 1)
        out = out.when(n < size * 1024, F.format_string(f"%.1f {unit}B", F.bround(n / size, 1)))
    return out


def bytes_of_bits(n: Column) -> Column:
    return F.ceil(n / 8)


def to_width(b: Column, width: int) -> Column:
    """Bytes as a hash or address of fixed width: the last bytes, padded with zeros on the left."""
    digits = F.lpad(F.hex(b), 2 * width, "0")
    return F.unhex(F.when(F.octet_length(b) > width, F.right(F.hex(b), F.lit(2 * width))).otherwise(digits))


def is_address(s: Column) -> Column:
    return s.rlike("^(0[xX])?[0-9a-fA-F]{40}$")


def nested_sizes(lists: Column) -> Column:
    """How many elements lie in an array of arrays."""
    return F.aggregate(lists, F.lit(0), lambda a, x: a + F.coalesce(F.size(x), F.lit(0)))


def csv_args(s: Column) -> Column:
    """Arguments of a comma-separated text, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")
