"""Raw transactions, packets and byte lists."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolake.functions import accounts, lists, rlp, secp256k1
from chronolake.functions import transactions as tx
from chronolake.functions.keccak import keccak256

#: Fixed value: the worked example of a signed legacy transaction in a public standard, and its sender.
LEGACY = bytes.fromhex(
    "f86c098504a817c800825208943535353535353535353535353535353535353535880de0b6b3a76400008025a028ef61340bd939bc2195fe537567866003e1a15d3c71ff63e1590620aa636276a067cbe9d8997f761aecb703304b3800ccf555c9f3dc64214b297fb1966a3b6d83"
)
SENDER = "9d8a62f656a8d1615c1294fd71e9cfb3e4855a4f"


def sign(kind, fields, key=0xABCDEF, k=0x1234567):
    digest = keccak256([bytes([kind]) + rlp.encode(fields)])[0]
    x, y = secp256k1.combine((k, secp256k1.G))
    s = pow(k, -1, secp256k1.N) * (int.from_bytes(digest) + x * key) % secp256k1.N
    return bytes([kind]) + rlp.encode([*fields, rlp.number(y % 2), rlp.number(x), rlp.number(s)])


def typed(kind):
    n, access = rlp.number, [[b"\x01" * 20, [b"\x02" * 32, b"\x03" * 32]], [b"\x04" * 20, []]]
    fields = [n(1), n(7), n(100), *([n(200)] if kind > 1 else []), n(21000), b"" if kind < 3 else b"\x05" * 20, n(10**20), b"a\0b", access]
    return sign(kind, fields + ([n(9), [b"\x06" * 32]] if kind == 3 else []))


def test_legacy():
    got = tx.parse(LEGACY)
    assert got["sender"].hex() == SENDER and got["id_hash"] == keccak256([LEGACY])[0]
    assert (got["nonce"], got["gas"], got["value"], got["tip"], got["creation"]) == (9, 21000, 10**18, 20 * 10**9, False)


def test_typed(spark):
    me = secp256k1.address(secp256k1.combine((0xABCDEF, secp256k1.G)))
    blob = typed(3)
    wrapped = b"\x03" + rlp.encode([rlp.decode(blob[1:]), [b"blob"], [b"c" * 48], [b"p" * 48]])
    df = spark.createDataFrame([(i, r) for i, r in enumerate([typed(1), typed(2), blob, wrapped, LEGACY, b"\x09\xc0", b"", None, b"\x02\xc1\x80", LEGACY[:-1]])], "i int, raw binary")
    got = [r[0] for r in df.orderBy("i").select(tx.parse_column(F.col("raw"))).collect()]
    assert [r.tx_type for r in got] == [1, 2, 3, 3, 0] + [None] * 5
    assert all(bytes(r.sender) == me for r in got[:4]) and bytes(got[4].sender).hex() == SENDER
    assert got[2].id_hash == got[3].id_hash and bytes(got[2].blob_hashes[0]) == b"\x06" * 32
    assert (got[1].tip, got[1].fee_cap, got[0].fee_cap, got[1].creation, got[2].creation) == (100, 200, 100, True, False)
    assert (got[1].data_len, got[1].data_nonzero_len, got[1].access_addresses, got[1].access_keys) == (3, 2, 2, 2)
    assert all(r.error for r in got[5:]) and not any(r.error for r in got[:5])


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_bad_bytes_are_value_errors(data):
    for f in (tx.parse, tx.parse_hashes_packet, tx.parse_transactions_packet, tx.parse_announcements):
        try:
            f(data)
        except ValueError:
            pass


def test_packets(spark):
    hashes = [bytes([i]) * 32 for i in range(3)]
    assert tx.parse_hashes_packet(tx.hashes_packet(0, hashes)) == (0, hashes)
    raws = [LEGACY, typed(2)]
    assert tx.parse_transactions_packet(tx.transactions_packet(2**64 - 1, raws)) == (2**64 - 1, raws)
    assert tx.parse_transactions_packet(tx.transactions_packet(None, raws), False) == (None, raws)
    assert tx.parse_announcements(tx.announcements([0, 2], [300, 0], hashes[:2])) == [(0, 300, hashes[0]), (2, 0, hashes[1])]
    df = spark.createDataFrame([(tx.hashes_packet(5, hashes),), (b"\x01",), (None,)], "p binary")
    got = df.mapInPandas(tx.explode_packets("p", tx.parse_hashes_packet), "request bigint, item binary").collect()
    assert sorted((r.request, bytes(r.item)) for r in got) == [(5, h) for h in hashes]


def test_lists(spark):
    values = [0, 1, 2**64 - 1]
    data = b"".join(v.to_bytes(8, "little") for v in values)
    df = spark.createDataFrame([(data,), (b"",), (b"abc",), (data * 2,), (None,)], "d binary")
    got = [r[0] for r in df.select(lists.numbers(F.col("d"), 5)).collect()]
    assert [int(x) for x in got[0]] == values and got[1] == [] and got[2:] == [None, None, None]
    items = [b"", b"abc", b"x" * 70]
    assert lists.pieces(lists.from_pieces(items), 3) == items and lists.pieces(b"", 3) == []
    for bad in (lists.from_pieces(items * 2), b"\x08\0\0\0\xff\0\0\0", b"\xff\0\0\0\0"):
        with pytest.raises(ValueError):
            lists.pieces(bad, 3)


def test_accounts_and_senders():
    r = random.Random(0)
    for _ in range(50):
        a = (r.choice([0, r.getrandbits(64)]), r.choice([0, r.getrandbits(256)]), r.choice([b"", b"h" * 32]), r.choice([0, 1, 300]))
        assert accounts.decode_full_account(accounts.encode_full_account(*a)) == a
        assert accounts.decode_sender(accounts.encode_sender(*a[:2])) == a[:2]
    assert accounts.encode_sender(0, 0) == b"\0" and accounts.encode_sender(1, 256).hex() == "030101020100"
    assert accounts.encode_full_account(1, 0).hex() == "0101000000"
    with pytest.raises(ValueError):
        accounts.decode_sender(b"\x01\x05")
