"""Byte forms of accounts and senders as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolake.functions import rlp


def _parts(*numbers: int) -> bytes:
    """Numbers one after another, each behind the count of its bytes."""
    return b"".join(bytes([len(b)]) + b for b in map(rlp.number, numbers))


def _numbers(data: bytes, n: int) -> list[int]:
    out, at = [], 0
    for _ in range(n):
        if at >= len(data) or at + 1 + data[at] > len(data):
            raise ValueError("account ends early")
        out.append(int.from_bytes(data[at + 1 : at + 1 + data[at]]))
        at += 1 + data[at]
    return out


@F.pandas_udf(T.BinaryType())
def encode_account(nonce: pd.Series, balance: pd.Series) -> pd.Series:
    """Nonce and balance (text of a whole number) as length-prefixed bytes; NULL if either is."""
    return pd.Series([None if pd.isna(n) or pd.isna(b) else _parts(int(n), int(b)) for n, b in zip(nonce, balance)], dtype=object)


@F.pandas_udf(T.StructType().add("nonce", T.LongType()).add("balance", T.StringType()))
def decode_account(data: pd.Series) -> pd.DataFrame:
    """The account of length-prefixed bytes; NULLs for NULL and for bytes that are none."""
    rows = []
    for x in data:
        try:
            rows.append(_numbers(bytes(x), 2) if x is not None else [None, None])
        except ValueError:
            rows.append([None, None])
    return pd.DataFrame({"nonce": pd.array([r[0] for r in rows], "Int64"), "balance": [None if r[1] is None else str(r[1]) for r in rows]})


def encode_full_account(nonce: int, balance: int, code_hash: bytes = b"", incarnation: int = 0) -> bytes:
    """All four parts of an account, each behind the count of its bytes."""
    return _parts(nonce, balance) + bytes([len(code_hash)]) + code_hash + _parts(incarnation)


def decode_full_account(data: bytes) -> tuple[int, int, bytes, int]:
    """The parts of an account; empty bytes are the empty one."""
    if not data:
        return 0, 0, b"", 0
    parts, at = [], 0
    for _ in range(4):
        if at >= len(data) or at + 1 + data[at] > len(data):
            raise ValueError("account ends early")
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return int.from_bytes(parts[0]), int.from_bytes(parts[1]), parts[2], int.from_bytes(parts[3])


def encode_sender(nonce: int, balance: int) -> bytes:
    """A byte that says which parts follow (1: nonce, 2: balance), then the parts that aren't 0, each behind its length."""
    return bytes([(nonce > 0) + 2 * (balance > 0)]) + b"".join(_parts(x) for x in (nonce, balance) if x)


def decode_sender(data: bytes) -> tuple[int, int]:
    if not data:
        return 0, 0
    given = [data[0] & 1, data[0] >> 1 & 1]
    values = iter(_numbers(data[1:], sum(given)))
    return next(values) if given[0] else 0, next(values) if given[1] else 0
