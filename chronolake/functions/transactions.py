"""Raw transactions and network packets as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolake.functions import rlp
from chronolake.functions.keccak import keccak256
from chronolake.functions.secp256k1 import recover

#: The fields of each transaction type before its signature, in their order.
FIELDS = {
    0: "nonce tip gas to value data",
    1: "chain nonce tip gas to value data access",
    2: "chain nonce tip cap gas to value data access",
    3: "chain nonce tip cap gas to value data access blob_cap blobs",
}

_whole = lambda name: T.StructField(name, T.DecimalType(38, 0))
SLOT = T.StructType(
    [T.StructField("tx_type", T.IntegerType()), T.StructField("id_hash", T.BinaryType()), T.StructField("sender", T.BinaryType()), T.StructField("nonce", T.LongType()), _whole("tip"), _whole("fee_cap"), T.StructField("gas", T.LongType())]
    + [_whole("value"), T.StructField("creation", T.BooleanType()), T.StructField("data_len", T.IntegerType()), T.StructField("data_nonzero_len", T.IntegerType()), T.StructField("access_addresses", T.IntegerType()), T.StructField("access_keys", T.IntegerType())]
    + [_whole("blob_fee_cap"), T.StructField("blob_hashes", T.ArrayType(T.BinaryType())), T.StructField("error", T.StringType())]
)


def _read(raw: bytes, with_sender: bool) -> tuple[dict, bytes, bytes, tuple]:
    """The slot of a raw transaction, without what needs hashes; the bytes its hash is of, those that were signed, and the
    signature."""
    if not raw:
        raise ValueError("empty")
    kind, body = (0, raw) if raw[0] >= 0xC0 else (raw[0], raw[1:])
    if kind not in FIELDS:
        raise ValueError("unknown transaction type")
    items = rlp.decode(body)
    if kind == 3 and isinstance(items, list) and len(items) == 4 and isinstance(items[0], list):
        items = items[0]
    names = FIELDS[kind].split()
    if not isinstance(items, list) or len(items) != len(names) + 3:
        raise ValueError("wrong number of fields")
    x = dict(zip(names, items))
    lists = {"access", "blobs"} & {*names}
    if any(isinstance(v, list) != (n in lists) for n, v in zip([*names, "v", "r", "s"], items)):
        raise ValueError("a field has the wrong form")
    if len(x["to"]) not in (0, 20):
        raise ValueError("bad recipient")
    v, r, s = (rlp.to_number(b) for b in items[-3:])
    prefix = bytes([kind]) if kind else b""
    access = x.get("access", [])
    if any(not isinstance(a, list) or len(a) != 2 or isinstance(a[0], list) or len(a[0]) != 20 or not isinstance(a[1], list) or any(isinstance(k, list) or len(k) != 32 for k in a[1]) for a in access):
        raise ValueError("bad access list")
    if any(isinstance(b, list) or len(b) != 32 for b in x.get("blobs", [])):
        raise ValueError("bad blob hash")
    to_sign, odd = b"", v
    if with_sender:
        signed = list(items[:-3])
        if kind == 0:
            odd = v - 27 if v < 35 else (v - 35) % 2
            if v >= 35:
                signed += [rlp.number((v - 35) // 2), b"", b""]
        if odd not in (0, 1):
            raise ValueError("bad signature")
        to_sign = prefix + rlp.encode(signed)
    slot = {
        "tx_type": kind,
        "id_hash": None,
        "sender": None,
        "nonce": rlp.to_number(x["nonce"], 8),
        "tip": rlp.to_number(x["tip"]),
        "fee_cap": rlp.to_number(x.get("cap", x["tip"])),
        "gas": rlp.to_number(x["gas"], 8),
        "value": rlp.to_number(x["value"]),
        "creation": not x["to"],
        "data_len": len(x["data"]),
        "data_nonzero_len": len(x["data"]) - x["data"].count(0),
        "access_addresses": len(access),
        "access_keys": sum(len(a[1]) for a in access),
        "blob_fee_cap": rlp.to_number(x["blob_cap"]) if kind == 3 else None,
        "blob_hashes": x.get("blobs"),
        "error": None,
    }
    return slot, prefix + rlp.encode(items), to_sign, (odd, r, s)


def parse_all(raws: Sequence[bytes], with_sender: bool = True) -> list[dict | ValueError]:
    """The slots of raw transactions, or the errors of those that are none; all hashes are made at once."""
    out: list[dict | ValueError] = []
    read: list[tuple] = []
    for raw in raws:
        try:
            read.append((len(out), *_read(raw, with_sender)))
            out.append(read[-1][1])
        except ValueError as e:
            out.append(e)
    for (_, slot, *_), h in zip(read, keccak256([r[2] for r in read])):
        slot["id_hash"] = h
    if with_sender:
        for (i, slot, _, _, signature), digest in zip(read, keccak256([r[3] for r in read])):
            slot["sender"] = recover(digest, *signature)
            if slot["sender"] is None:
                out[i] = ValueError("bad signature")
    return out


def parse(raw: bytes, with_sender: bool = True) -> dict:
    """The slot of one raw transaction, legacy or typed, with or without the blobs beside it. Errors are ValueErrors."""
    slot = parse_all([raw], with_sender)[0]
    if isinstance(slot, ValueError):
        raise slot
    return slot


def parse_column(raw: Column, with_sender: bool = True) -> Column:
    """A struct (SLOT) of each raw transaction; bytes that are none have their ``error`` set and NULLs elsewhere, numbers
    above 10^38 - 1 too. NULL has the error "empty"."""
    top = 10**38

    @F.pandas_udf(SLOT)
    def run(batch: pd.Series) -> pd.DataFrame:
        import decimal

        rows = []
        for row in parse_all([bytes(x) if x is not None else b"" for x in batch], with_sender):
            try:
                if isinstance(row, ValueError):
                    raise row
                if any(isinstance(row[f.name], int) and isinstance(f.dataType, T.DecimalType) and row[f.name] >= top or isinstance(f.dataType, T.LongType) and row[f.name] >= 2**63 for f in SLOT):
                    raise ValueError("number too large")
            except ValueError as e:
                row = dict.fromkeys(SLOT.names) | {"error": str(e)}
            rows.append([decimal.Decimal(row[f.name]) if isinstance(f.dataType, T.DecimalType) and row[f.name] is not None else row[f.name] for f in SLOT])
        df = pd.DataFrame(rows, columns=SLOT.names, dtype=object)
        for f in SLOT:
            if isinstance(f.dataType, (T.IntegerType, T.LongType)):
                df[f.name] = df[f.name].astype("Int64" if isinstance(f.dataType, T.LongType) else "Int32")
        return df

    return run(raw)


# packets: (request id, list of hashes) and (request id, list of transactions)


def hashes_packet(request: int, hashes: list[bytes]) -> bytes:
    return rlp.encode([rlp.number(request), list(hashes)])


def parse_hashes_packet(data: bytes) -> tuple[int, list[bytes]]:
    request, hashes = _pair(rlp.decode(data))
    if any(not isinstance(h, bytes) or len(h) != 32 for h in hashes):
        raise ValueError("not a hash")
    return request, hashes


def transactions_packet(request: int | None, raws: list[bytes]) -> bytes:
    """Legacy transactions lie in the list as they are, typed ones as strings; without a request id it is the list alone."""
    body = b"".join(r if r[:1] >= b"\xc0" else rlp.encode(r) for r in raws)
    inner = rlp._prefix(0xC0, len(body)) + body
    if request is None:
        return inner
    head = rlp.encode(rlp.number(request))
    return rlp._prefix(0xC0, len(head) + len(inner)) + head + inner


def parse_transactions_packet(data: bytes, with_request: bool = True) -> tuple[int | None, list[bytes]]:
    items = rlp.decode(data)
    request, txs = _pair(items) if with_request else (None, items)
    if not isinstance(txs, list):
        raise ValueError("not a list")
    if not all(txs):
        raise ValueError("empty transaction")
    return request, [rlp.encode(t) if isinstance(t, list) else t for t in txs]


def _pair(items) -> tuple[int, list]:
    if not isinstance(items, list) or len(items) != 2 or isinstance(items[0], list) or not isinstance(items[1], list):
        raise ValueError("not a request and a list")
    return rlp.to_number(items[0], 8), items[1]


def explode_packets(column: str, parse_one: Callable[[bytes], tuple[int, list[bytes]]]):
    """A function for mapInPandas: packets of ``column`` to rows (``request``, ``item``); packets that aren't are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch[column]:
                try:
                    request, items = parse_one(bytes(x)) if x is not None else (0, [])
                except ValueError:
                    continue
                rows += [(request, i) for i in items]
            yield pd.DataFrame(rows, columns=["request", "item"])

    return run


# announcements: kinds, sizes and hashes of transactions


def announcements(kinds: list[int], sizes: list[int], hashes: list[bytes]) -> bytes:
    return rlp.encode([bytes(kinds), [rlp.number(s) for s in sizes], list(hashes)])


def parse_announcements(data: bytes) -> list[tuple[int, int, bytes]]:
    items = rlp.decode(data)
    if not isinstance(items, list) or len(items) != 3 or [isinstance(x, list) for x in items] != [False, True, True] or not len(items[0]) == len(items[1]) == len(items[2]):
        raise ValueError("not three equally long lists")
    if any(isinstance(h, list) or len(h) != 32 for h in items[2]) or any(isinstance(s, list) for s in items[1]):
        raise ValueError("not a hash or a size")
    return [(k, rlp.to_number(s, 4), h) for k, s, h in zip(*items)]
