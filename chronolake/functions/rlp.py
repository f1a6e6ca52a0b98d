"""Recursive length prefix: nested lists of byte strings as bytes."""

from __future__ import annotations

Item = bytes | list


def encode(item: Item) -> bytes:
    """A byte string or a list of items; the shortest form of each length."""
    if isinstance(item, bytes):
        if len(item) == 1 and item[0] < 0x80:
            return item
        return _prefix(0x80, len(item)) + item
    body = b"".join(map(encode, item))
    return _prefix(0xC0, len(body)) + body


def _prefix(base: int, n: int) -> bytes:
    if n < 56:
        return bytes([base + n])
    size = number(n)
    return bytes([base + 55 + len(size)]) + size


def number(n: int) -> bytes:
    """A number without leading zeros; 0 is empty."""
    return n.to_bytes((n.bit_length() + 7) // 8)


def to_number(b: bytes, most: int = 32) -> int:
    """The number of a byte string; an error if it has leading zeros or more than ``most`` bytes."""
    if len(b) > most or b[:1] == b"\0":
        raise ValueError("not a number in its shortest form")
    return int.from_bytes(b)


def _head(data: bytes, at: int, end: int) -> tuple[bool, int, int]:
    """Whether the item at a position is a list, where its content begins and where it ends."""
    if at >= end:
        raise ValueError("unexpected end")
    first = data[at]
    if first < 0x80:
        return False, at, at + 1
    is_list = first >= 0xC0
    n = first - (0xC0 if is_list else 0x80)
    begin = at + 1
    if n > 55:
        width = n - 55
        size = data[begin : begin + width]
        if len(size) < width or begin + width > end or size[0] == 0:
            raise ValueError("bad length")
        n, begin = int.from_bytes(size), begin + width
        if n < 56:
            raise ValueError("length not in its shortest form")
    if begin + n > end:
        raise ValueError("content beyond the end")
    if not is_list and n == 1 and data[begin] < 0x80:
        raise ValueError("single byte not in its shortest form")
    return is_list, begin, begin + n


def decode_at(data: bytes, at: int, end: int) -> tuple[Item, int]:
    """The item at a position and where the next begins."""
    is_list, begin, stop = _head(data, at, end)
    if not is_list:
        return data[begin:stop], stop
    items = []
    while begin < stop:
        item, begin = decode_at(data, begin, stop)
        items.append(item)
    return items, stop


def decode(data: bytes) -> Item:
    """The one item of ``data``; an error if anything follows it."""
    item, stop = decode_at(data, 0, len(data))
    if stop != len(data):
        raise ValueError("bytes after the item")
    return item
