"""What is kept between runs, and trees, suffixes and covers, against plain models: nulls, repeats, empty tables."""

import heapq
import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chronolake.operators import commitment, etl, formats, kv, overlay, pool
from chronolake.operators import index as ix
from chronolake.operators import lifecycle as lc
from chronolake.operators import temporal as tp
from chronolake.sources import pages
from chronolake.sources.store import VersionedTable

KV = "k long, v long"


def test_chunks_hold_every_entry_once(spark):
    data = [(i % 7, i) for i in range(60)] + [(3, 3)] * 40 + [(None, 1)]
    parts = [rows(p) for p in kv.chunks(spark.createDataFrame(data, KV), 4)]
    assert sorted(map(str, itertools.chain(*parts))) == sorted(map(str, data))
    keys = [{k for k, _ in p} for p in parts]
    assert all(not a & b for a, b in itertools.combinations(keys, 2)) and keys[-1] == {None}
    assert [p.count() for p in kv.chunks(spark.createDataFrame([], KV), 3)] == [0, 0]
    ahead = kv.read_ahead(spark.createDataFrame(data, KV), 5, 3)
    assert [r.k for r in ahead.collect()] == [5, 5, 5] and ahead.storageLevel.useMemory
    ahead.unpersist()


def test_index_takes_more(spark):
    index = spark.createDataFrame([("a", "1", 5)], "name string, k string, tx long")
    more = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("a", 1, 6), ("b", None, 1), ("b", 2, None)], "name string, k int, tx long")
    assert rows(ix.put(index, more)) == [("a", "1", 5), ("a", "1", 6)] and ix.put(index.limit(0), more.limit(0)).count() == 0


def test_prune_in_time_goes_on_where_it_stopped(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "hot"))
    store.commit(spark.createDataFrame([(t,) for t in range(20)], "tx long"))
    assert lc.prune_in_time(store, 0, 12, batch=5, seconds=0.0) == 0 and store.versions() == [1]
    ticks = iter([0, 1, 2, 99, 99])
    assert lc.prune_in_time(store, 0, 12, batch=5, seconds=10, clock=lambda: next(ticks)) == 10
    assert rows(store.view()) == [(t,) for t in range(10, 20)]
    assert lc.prune_in_time(store, 10, 12, batch=5, seconds=60) == 12 and store.view().count() == 8


def test_writes_that_wait(spark, tmp_path):
    wal, one = lc.Wal(spark, str(tmp_path / "w")), spark.createDataFrame([(1,)], "tx long")
    wal.write(one)
    assert wal.hot() is None
    wal.discard()
    wal.write(one)
    wal.write(one.limit(0))
    taken = wal.rotate()
    wal.write(one)
    assert wal.flush(taken) == 1 and wal.hot().count() == 1 and lc.Wal(spark, str(tmp_path / "w")).hot().count() == 1


def test_deleting_cascades_to_living_children(spark):
    log = lambda *x: spark.createDataFrame(list(x), "k string, tx long, v long")
    w = tp.Writes({"acc": log(("a", 1, 1)), "sto": log(("a/x", 1, 1), ("a/x", 2, None), ("a/y", 1, 3), ("b/x", 1, 4), (None, 1, 1))}, spark.createDataFrame([], "name string, k string, tx long"), parent="acc", child="sto")
    w.delete(spark.createDataFrame([("a", 9), ("zz", 9), ("a", 9)], "k string, tx long"))
    assert rows(w.domains["sto"].where("tx = 9")) == [("a/y", 9, None)] and rows(w.domains["acc"].where("tx = 9")) == [("a", 9, None), ("zz", 9, None)]
    w.delete(spark.createDataFrame([], "k string, tx long"))
    assert w.domains["sto"].count() == 6


def test_blocks_must_follow(spark):
    b = lambda *x: spark.createDataFrame([(n, n * 10) for n in x], "block long, max_tx long")
    assert rows(tp.append_blocks(b(0, 1), b(3, 2)).select("block")) == [(0,), (1,), (2,), (3,)]
    assert rows(tp.append_blocks(b().limit(0), b(7)).select("block")) == [(7,)]
    for bad in (b(3), b(2, 4), b(1)):
        with pytest.raises(Exception, match="out of order"):
            tp.append_blocks(b(0, 1), bad).collect()
    assert tuple(tp.first_last_block(b()).first()) == (None, None, None, None)


def test_following_keys(spark):
    keys = [b"\x11\xff", b"\x00", b"\xfe\xff\xff", None, b"\x0f"]
    got = [r[0] and bytes(r[0]) for r in spark.createDataFrame([(k,) for k in keys], "k binary").select(etl.following_key(F.col("k"))).collect()]
    assert got == [etl.next_key(k) if k else None for k in keys]
    for bad in (b"", b"\xff\xff"):
        with pytest.raises(Exception, match="no next"):
            spark.createDataFrame([(bad,)], "k binary").select(etl.following_key(F.col("k"))).collect()


def test_batch_over_a_base(spark):
    t = lambda *x: spark.createDataFrame(list(x), KV)
    b = overlay.Batch(t((1, 1), (2, 2)), {"s": 5})
    assert rows(b.read()) == [(1, 1), (2, 2)]
    b.delete(t((1, 0), (9, 0)))
    b.put(t((1, 7), (1, 3), (4, None)))
    assert rows(b.read()) == [(1, 7), (2, 2), (4, None)] and b.increment("s", 2) == 5 and b.increment("new", 1) == 0
    b.clear()
    assert b.read().count() == 0
    b.put(t((3, 3)))
    assert rows(b.read()) == [(3, 3)]


@pytest.mark.parametrize("size", [1, 4, 100])
def test_pages_round_trip(spark, tmp_path, size):
    data = [(i, None if i % 5 == 0 else f"v{i}") for i in range(13)] + [(3, "v3"), (None, "x")]
    pages.register(spark)
    pages.write_pages(spark.createDataFrame(data, "k long, v string"), str(tmp_path / "p"), 3, size)
    assert rows(spark.read.format("pages").load(str(tmp_path / "p"))) == sorted((d for d in data if d[0] is not None), key=lambda d: (d[0], d[1] is not None, d[1]))
    pages.write_pages(spark.createDataFrame([], "k long, v string"), str(tmp_path / "none"), 2, size)
    assert not (tmp_path / "none").exists() or spark.read.format("pages").load(str(tmp_path / "none")).count() == 0


def test_suffixes(spark):
    texts = [(1, "banana"), (2, "ana"), (3, None), (4, ""), (5, "ana")]
    got = formats.suffix_array(spark.createDataFrame(texts, "i long, t string"), "i", "t", depth=3).orderBy("rank").collect()
    want = sorted((t[p : p + 3], i, p) for i, t in texts if t for p in range(len(t)))
    assert [(r.i, r.pos) for r in got] == [w[1:] for w in want] and [r["rank"] for r in got] == [*range(len(want))]
    lcp = [None] + [next((n for n in range(4) if a[0][: n + 1] != b[0][: n + 1] or n == min(len(a[0]), len(b[0]))), 3) for a, b in zip(want, want[1:])]
    assert [r.lcp for r in got] == lcp
    assert formats.suffix_array(spark.createDataFrame([], "i long, t string"), "i", "t").count() == 0


@pytest.mark.parametrize("least", [2, 4])
def test_frequent_substrings_against_model(spark, least):
    r = random.Random(3)
    texts = [("".join(r.choice("ab") for _ in range(r.randint(0, 24))), 1) for _ in range(30)] + [(None, 1), ("ab" * 40, 1)]
    count = {}
    for t, _ in texts:
        for n in range(2, 24):
            for p in range(len(t or "") - n + 1):
                count[t[p : p + n]] = count.get(t[p : p + n], 0) + 1
    want = sorted((p, n, (n - 1) * len(p)) for p, n in count.items() if n >= least)
    df = spark.createDataFrame(texts, "t string, n int")
    assert rows(formats.frequent_substrings(df, "t", 2, 23, least)) == want
    assert formats.frequent_substrings(df.limit(0), "t", 2, 23).count() == 0


def test_cover_is_cheapest(spark):
    r = random.Random(4)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 6))) for _ in range(12)]
    texts = [(i, "".join(r.choice("abc") for _ in range(r.randint(0, 14)))) for i in range(40)] + [(99, None)]

    def cheapest(t):
        cost = [0]
        for at in range(1, len(t) + 1):
            cost.append(min([cost[-1] + 1] + [cost[at - len(w)] + 2 for w in words if t[:at].endswith(w)]))
        return cost[-1]

    df, d = spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame([(w,) for w in [*words, None, ""]], "word string")
    got = {x.i: x for x in formats.cover(df, d, text_id="i", text="t").collect()}
    assert got.keys() == {i for i, t in texts if t is not None}
    for i, t in texts:
        if t is not None:
            assert "".join(got[i].pieces) == t and got[i].cost == cheapest(t) == sum(2 if len(p) > 1 else 1 for p in got[i].pieces)
    assert formats.cover(df, d.limit(0), text_id="i", text="t").where("size(pieces) <> cost").count() == 0


def test_code_lengths_are_optimal():
    r = random.Random(8)
    for n in (1, 2, 3, 9, 60):
        counts = {f"s{i}": r.randint(1, 50) for i in range(n)}
        bits = formats.code_lengths(counts)
        assert sum(2.0 ** -b for b in bits.values()) <= 1
        heap, total = list(counts.values()), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            total += x
            heapq.heappush(heap, x)
        assert sum(counts[s] * bits[s] for s in counts) == (total if n > 1 else counts["s0"])


ENTRIES = "k binary, v binary"


def test_tree_state_follows_changes(spark, tmp_path):
    r = random.Random(2)
    state = {f"k{i}".encode(): b"v%d" % i for i in range(300)}
    frame = lambda: spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in state.items()], ENTRIES)
    for depth in (1, 2):
        tree = commitment.TreeState(spark, str(tmp_path / f"t{depth}"), depth)
        tree.save(frame())
        assert tree.root().first()[0] == commitment.state_root(frame()).first()[0]
        touched = r.sample(sorted(state), 20) + [b"new1", b"new2", b"never"]
        for i, k in enumerate(touched):
            if i % 3 == 0:
                state.pop(k, None)
            elif k != b"never":
                state[k] = b"changed%d" % depth
        tree.update(frame(), spark.createDataFrame([(bytearray(k),) for k in touched] + [(None,)], "k binary"))
        assert tree.root().first()[0] == commitment.state_root(frame()).first()[0]
    tree.update(frame().limit(0), frame().select("k"))
    assert tree.root().first()[0] == commitment.EMPTY_ROOT.hex()


def test_binary_tree(spark):
    data = [(bytearray(f"k{i}".encode()), bytearray(b"v%d" % i)) for i in range(70)]
    df = spark.createDataFrame(data, ENTRIES)
    roots = {commitment.state_root(df, depth, radix=2).first()[0] for depth in (0, 1, 5, 8, 9)}
    assert len(roots) == 1 and roots != {commitment.state_root(df).first()[0]}
    assert commitment.state_root(df.limit(69), radix=2).first()[0] not in roots
    assert commitment.state_root(df.limit(0), radix=2).first()[0] == commitment.EMPTY_ROOT.hex()
    keys = random.Random(1).sample(range(1 << 12), 50)
    got = rows(commitment.binary_branches(spark.createDataFrame([(k,) for k in [*keys, keys[0], None]], "k int"), "k", 12))
    bits = sorted(f"{k:012b}" for k in keys)
    prefixes = {p[:n] for p in bits for n in range(12) if {q[n] for q in bits if q.startswith(p[:n])} == {"0", "1"}}
    assert got == sorted((len(p), int(p, 2) if p else 0) for p in prefixes) and len(got) == 49


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 9, 26, 27, 80, 500])
def test_tree23_is_one(spark, n):
    got = [tuple(r) for r in commitment.tree23(spark.createDataFrame([(i * 3,) for i in range(n)] + [(None,), (0,)][: 1 + (n > 0)], "k long"), "k").collect()]
    assert sorted(k for k, _, _ in got) == [i * 3 for i in range(n)]
    nodes = {}
    for k, level, node in got:
        nodes.setdefault((level, node), []).append(k // 3)
    height = max((level for level, _ in nodes), default=0)

    def walk(level, first):
        keys = sorted(nodes[level, first])
        assert 1 <= len(keys) <= 2
        if level == 1:
            assert keys[0] == first
            return keys[-1]
        at = first
        for k in [*keys, None]:
            end = walk(level - 1, at)
            assert k is None or end + 1 == k
            at = end + 2
        return at - 2

    assert not n or walk(height, 0) == n - 1


def test_pool_that_is_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, True, True, 5), (2, True, True, 1), (3, None, True, 9), (4, True, False, 9), (5, True, True, None), (6, True, True, 7)], "id long, no_gap boolean, covered boolean, fee long")
    got = pool.classify(df, fee="fee", base_fee=5, order=[F.desc("fee"), F.asc("id")], limits={"pending": 1, "base_fee": 5, "queued": 5})
    assert rows(got.select("id", "pool")) == [(2, "base_fee"), (3, "queued"), (4, "queued"), (5, "base_fee"), (6, "pending")]
    store = pool.PoolStore(spark, str(tmp_path / "p"))
    with pytest.raises(LookupError):
        store.load()
    store.flush(got, 9)
    store.flush(got.limit(0), 10)
    kept, block = store.load()
    assert (kept.count(), block) == (0, 10) and kept.columns == got.columns and rows(pool.status(got)) == [("base_fee", 2), ("pending", 1), ("queued", 2)]


def test_perfect_hash(spark):
    keys = [f"key {i}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in [*keys, keys[0], None]], "k string")
    index = formats.perfect_hash(df, "k")
    got = formats.lookup(index, spark.createDataFrame([(k, 1) for k in [*keys, "unknown", None]], "k string, seed int"), "k").collect()
    assert sorted(r.ordinal for r in got if r.k in {*keys}) == [*range(3000)] and [r.ordinal for r in got if r.k is None] == [None]
    assert formats.perfect_hash(df.limit(0), "k").count() == 0 and formats.lookup(index.limit(0), df.limit(1), "k").count() == 1


def test_touched_keys_have_the_path_of_their_hash(spark):
    from chronolake.functions.keccak import keccak256

    log = spark.createDataFrame([(1, 5), (1, 6), (2, 4), (None, 9), (37, 5)], "k long, tx long")
    assert rows(commitment.touched_keys(log, 5)) == sorted((k, keccak256([str(k).encode()])[0].hex()) for k in (1, 37))
