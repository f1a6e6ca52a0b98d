"""Lists of fixed-size elements in bytes, little endian, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunks(data: Column, width: int, most: int) -> Column:
    """Elements of ``width`` bytes; NULL if the length isn't a multiple of it or there are more than ``most``."""
    n = F.octet_length(data)
    at = F.when(n > 0, F.sequence(F.lit(0), (n / width).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.when((n % width == 0) & (n <= width * most), F.transform(at, lambda i: F.substring(data, i * width + 1, F.lit(width))))


def numbers(data: Column, most: int) -> Column:
    """64-bit numbers of 8 bytes each, as decimal(20,0)."""
    big_endian = lambda b: F.conv(F.concat(*[F.hex(F.substring(b, i, 1)) for i in range(8, 0, -1)]), 16, 10).cast("decimal(20,0)")
    return F.transform(chunks(data, 8, most), big_endian)


def pieces(data: bytes, most: int) -> list[bytes]:
    """Elements of different sizes behind a table of their offsets (4 bytes each); an error if the offsets don't fit."""
    if len(data) <= 4:
        return []
    first = int.from_bytes(data[:4], "little")
    n = first // 4
    if n > most or first > len(data):
        raise ValueError("too many elements")
    at = [int.from_bytes(data[4 * i : 4 * i + 4], "little") for i in range(n)] + [len(data)]
    if any(a > b or b > len(data) for a, b in zip(at, at[1:])):
        raise ValueError("bad offset")
    return [data[a:b] for a, b in zip(at, at[1:])]


def from_pieces(items: list[bytes]) -> bytes:
    offsets, at = b"", 4 * len(items)
    for x in items:
        offsets += at.to_bytes(4, "little")
        at += len(x)
    return offsets + b"".join(items)
