"""Operators against literal results and plain models."""

import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolake.functions import codec, rlp
from chronolake.functions.accounts import decode_account, encode_account
from chronolake.functions.keccak import keccak256
from chronolake.operators import commitment, etl, formats, kv, overlay, pool, streams
from chronolake.operators import index as ix
from chronolake.operators import lifecycle as lc
from chronolake.operators import temporal as tp
from chronolake.operators.ordered import global_rank, neighbour, running


@pytest.mark.parametrize("hot_rows", [10**9, 25])
def test_neighbours_and_running(spark, hot_rows):
    r = random.Random(4)
    data = [("a" if r.random() < 0.6 else r.choice(["b", None]), r.choice([None, *range(40)]), i, r.choice([None, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t long, i long, v long")
    want_prev, want_next, want_sum, want_rank = [], [], [], []
    for k in {d[0] for d in data}:
        seq = sorted((d for d in data if d[0] == k), key=lambda d: (d[1] is not None, d[1] or 0, d[2]))
        total, least = None, None
        for j, d in enumerate(seq):
            want_prev.append((d[2], seq[j - 1][2] if j else None))
            want_next.append((d[2], seq[j + 1][2] if j + 1 < len(seq) else None))
            if d[3] is not None:
                total, least = (total or 0) + d[3], min(d[3], least if least is not None else 9)
            want_sum.append((d[2], total, least, j + 1))
    for j, d in enumerate(sorted(data, key=lambda d: (d[1] is not None, d[1] or 0, d[2]))):
        want_rank.append((d[2], j))
    kw = dict(time="t", ties=["i"], hot_rows=hot_rows)
    assert rows(neighbour(df, keys=["k"], take={"p": "i"}, **kw).select("i", "p")) == sorted(want_prev)
    assert rows(neighbour(df, keys=["k"], follow={"n": "i"}, **kw).select("i", "n")) == sorted(want_next)
    assert rows(running(df, keys=["k"], sums={"s": "v"}, mins={"m": "v"}, **kw).select("i", "s", "m", "rank")) == sorted(want_sum)
    assert rows(global_rank(df, order="t", ties=["i"], hot_rows=hot_rows).select("i", "rank")) == sorted(want_rank)
    assert neighbour(df.limit(0), keys=[], take={"p": "i"}, **kw).count() == 0


# key-value tables: (key1, value1.1), (key1, value1.3), (key3, value3.1), (key3, value3.3)


@pytest.fixture
def dups(spark):
    return spark.createDataFrame([("key1", "value1.1"), ("key1", "value1.3"), ("key3", "value3.1"), ("key3", "value3.3")], "k string, v string")


def test_ranges(spark, dups):
    assert rows(kv.key_range(dups, "key1", "key3")) == [("key1", "value1.1"), ("key1", "value1.3")]
    down = kv.key_range(dups, "key3", "key1", asc=False, limit=5).collect()
    assert [r.v for r in down] == ["value3.3", "value3.1"]
    assert kv.key_range(dups, limit=0).count() == 0 and kv.key_range(dups, limit=-1).count() == 4
    with pytest.raises(ValueError):
        kv.key_range(dups, "key3", "key1")
    assert rows(kv.dup_range(dups, "key3", "value3.2").select("v")) == [("value3.3",)]
    assert kv.dup_range(dups, "key2").count() == 0
    assert rows(kv.first_and_last(dups)) == [("first", "key1", "value1.1"), ("last", "key3", "value3.3")]
    assert kv.first_and_last(dups.limit(0)).count() == 0
    assert rows(kv.prefix_scan(dups, "key3").select("v")) == [("value3.1",), ("value3.3",)]
    assert rows(kv.dup_summary(dups)) == [("key1", "value1.1", "value1.3", 2), ("key3", "value3.1", "value3.3", 2)]


def test_subtree_and_next_key():
    assert kv.next_subtree(bytes.fromhex("11ff")) == b"\x12" and kv.next_subtree(b"\xff\xff") is None
    assert etl.next_key(bytes.fromhex("11ff")) == bytes.fromhex("1200")
    for bad in (b"", b"\xff"):
        with pytest.raises(ValueError):
            etl.next_key(bad)


def test_masked_prefix(spark):
    df = spark.createDataFrame([(bytes([a, b]),) for a in (0x5A, 0x5B) for b in range(0, 256, 16)] + [(b"\x5a",), (None,)], "k binary")
    got = {bytes(r[0]) for r in kv.masked_prefix(df, b"\x5a\xc0", 10).collect()}
    assert got == {bytes([0x5A, b]) for b in (0xC0, 0xD0, 0xE0, 0xF0)}
    assert kv.masked_prefix(df, b"\x5a", 8).count() == 17


def test_seek(spark):
    t = spark.createDataFrame([(3,), (8,), (8,), (None,)], "k long")
    p = spark.createDataFrame([(1,), (3,), (4,), (9,), (None,)], "probe long")
    assert rows(kv.seek(t, p)) == [(1, 3), (3, 3), (4, 8)]


def test_writes(spark):
    t, up = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k long, v string, seq long")
    assert rows(kv.put(t, up, "seq")) == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(kv.put_if_absent(t, up.where("seq = 1"))) == [(1, "a"), (2, "b"), (3, "z")]
    assert rows(kv.delete(t, up.select("k"))) == [(1, "a")]
    assert rows(kv.appended_in_order(t, up.where("k = 3").select("k", "v"))) == [(1, "a"), (2, "b"), (3, "z")]
    with pytest.raises(Exception, match="out of order"):
        kv.appended_in_order(t, up.select("k", "v")).collect()
    assert rows(kv.appended_in_order(t.limit(0), t)) == rows(t)


# streams


def stream(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def test_stream_literals(spark):
    assert [r[0] for r in streams.union(stream(spark, 1, 3, 6, 7), stream(spark, 2, 3, 7, 8)).orderBy("v").collect()] == [1, 2, 3, 6, 7, 8]
    assert [r[0] for r in streams.union(stream(spark, 7, 6, 3, 1), stream(spark, 8, 7, 3, 2), asc=False, limit=2).collect()] == [8, 7]
    assert [r[0] for r in streams.union(stream(spark, 1, 2, 3), stream(spark), limit=2).collect()] == [1, 2]
    assert rows(streams.intersect(stream(spark, 1, 3, 4, 5, 6, 7), stream(spark, 2, 3, 7))) == [(3,), (7,)]
    assert rows(streams.intersect(stream(spark, 1, 3, 4, 5, 6, 7), stream(spark, 2, 3, 7), 1)) == [(3,)]
    pair = lambda *p: spark.createDataFrame(list(p), "k long, v long")
    assert rows(streams.union_pairs(pair((1, 1), (3, 1), (4, 1)), pair((2, 9), (3, 9)))) == [(1, 1), (2, 9), (3, 1), (4, 1)]
    assert rows(streams.numbers(spark, 1, 4)) == [(1,), (2,), (3,)] and rows(streams.numbers(spark, 1, 1)) == [(1,)]
    paged = [[r[0] for r in p.collect()] for p in streams.pages(stream(spark, *range(1, 8)), "v", 3)]
    assert paged == [[1, 2, 3], [4, 5, 6], [7]]
    assert streams.same(stream(spark, 1, 1, 2), stream(spark, 2, 1, 1)) and not streams.same(stream(spark, 1), stream(spark, 1, 1))
    with pytest.raises(Exception, match="expected error"):
        streams.failing(stream(spark, 1, 2, 3), 2, "v").collect()


# the arithmetic change log: key k changes at every multiple of k, to tx div k


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(k, tx, tx // k) for k in range(1, 32) for tx in range(k, 1001, k)], "k long, tx long, v long")


def tiers(log):
    """The same log as it is, as two tiers, and cut into step files and merged again."""
    yield log
    yield log.where("tx < 976").union(log.where("tx >= 976"))
    yield log.repartition(3, "tx")


def test_history_goldens(spark, log):
    for tier in tiers(log):
        h = tp.history(tier)
        assert rows(tp.history_range(h, 2, 20)) == [(k, 1 if k == 1 else None) for k in range(1, 20)]
        got = tp.history_range(h, 995, 1000).orderBy("k").collect()
        assert [r.k for r in got] == [1, 2, 3, 4, 5, 6, 9, 12, 27] and [f"{r.v:x}" for r in got] == "3e2 1f1 14b f8 c6 a5 6e 52 24".split()
        got = tp.history_range(h, 995).orderBy("k").collect()
        assert [r.k for r in got] == [1, 2, 3, 4, 5, 6, 8, 9, 10, 12, 20, 25, 27]
        assert [f"{r.v:x}" for r in got] == "3e2 1f1 14b f8 c6 a5 7c 6e 63 52 31 27 24".split()
        assert [r.k for r in tp.history_range(h, 995, None, 2).collect()] == [1, 2]
        assert [f"{r.v:x}" for r in tp.history_range(h, 976, 1000, 2).collect()] == ["3cf", "1e7"]
        probes = spark.createDataFrame([(1, 0), (1, 900), (1, 1000), (1, 1001)], "k long, at long")
        assert rows(tp.get_no_state(h, probes)) == [(1, 0, True, None), (1, 900, True, 0x383), (1, 1000, True, 0x3E7), (1, 1001, False, None)]
        assert rows(ix.changed_keys(tier, 0, 20)) == [(k,) for k in range(1, 20)]
        assert [r[0] for r in rows(ix.changed_keys(tier, 995, 1000))] == [1, 2, 3, 4, 5, 6, 9, 12, 27]


@pytest.mark.parametrize("at", [0, 1, 17, 500, 1000, 2000])
def test_as_of_both_ways(log, at):
    want = [(k, min(at - 1, 1000) // k) for k in range(1, 32) if at - 1 >= k]
    assert rows(tp.as_of(log, at)) == want
    assert rows(tp.as_of_by_history(tp.history(log), at)) == want


def test_index_ranges(log):
    i = ix.build(log, key="k")
    for key in (1, 2, 7, 31):
        times = list(range(key, 1001, key))
        got = lambda *a, key=key, **kw: [r[0] for r in ix.index_range(i, "key", str(key), *a, **kw).collect()]
        assert sorted(got(0, 976)) == [t for t in times if t < 976]
        assert got(975, 0, asc=False, limit=1000) == [t for t in reversed(times) if t <= 975]
        assert got(limit=2) == times[:2] and got(asc=False, limit=2) == times[-2:][::-1]
        assert sorted(got(100, 102)) == [t for t in times if 100 <= t < 102]
    with pytest.raises(ValueError):
        ix.index_range(i, "key", "1", 5, 4)


def test_steps_merge_prune_invariance(spark, log, tmp_path):
    c = lc.collate_domain(log, 16)
    lc.write_steps(c, str(tmp_path / "steps"))
    back = lc.read_steps(spark, str(tmp_path / "steps"))
    latest = rows(tp.latest(log))
    assert rows(lc.merge_domain(back, 0, 10**6)) == latest
    halves = lc.merge_domain(back, 0, 32).withColumn("step", F.lit(0)).unionByName(lc.merge_domain(back, 32, 10**6).withColumn("step", F.lit(1)))
    assert rows(lc.merge_domain(halves, 0, 2)) == latest
    assert rows(lc.merge_domain(lc.prune_domain(c, 40), 0, 10**6)) == latest
    assert rows(tp.latest(lc.unwind(log, 500))) == rows(tp.as_of(log, 500))
    assert lc.read_steps(spark, str(tmp_path / "steps"), 60, 62).select("step").distinct().count() == 2


def test_merge_planning(spark):
    f = lambda *r: spark.createDataFrame([("x", *x) for x in r], "name string, start_step long, end_step long")
    assert lc.next_merge(f((0, 2), (2, 3), (3, 4))) == (0, 4)
    assert lc.next_merge(f((0, 1), (1, 2), (2, 3), (3, 4))) == (0, 4)
    assert lc.next_merge(f((0, 1), (1, 2))) == (0, 2)
    assert lc.next_merge(f((0, 4))) is None and lc.next_merge(f((0, 4)).limit(0)) is None
    assert lc.merged_plan([(i, i + 1) for i in range(70)]) == [(0, 32), (32, 64), (64, 68), (68, 70)]
    assert rows(lc.not_covered(f((0, 4), (0, 2), (1, 4), (4, 5), (4, 5), (3, 6)))) == [("x", 0, 4), ("x", 3, 6)]


def test_no_op_writes_and_deletions(spark):
    log = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, None), (1, 4, None), (2, 1, None), (2, 2, 7)], "k long, tx long, v long")
    assert rows(tp.changes_only(log).select("k", "tx")) == [(1, 1), (1, 3), (2, 2)]
    assert rows(tp.latest(log)) == [(2, 7)] and rows(tp.latest(log, deleted=True)) == [(1, None), (2, 7)]
    assert rows(tp.as_of(log, 3)) == [(1, 5), (2, 7)]


def test_blocks(spark):
    b = spark.createDataFrame([(0, 4), (1, 9), (2, 9), (5, 20)], "block long, max_tx long")
    assert rows(tp.block_bounds(b)) == [(0, 0, 4), (1, 5, 9), (2, 10, 9), (5, 10, 20)]
    t = spark.createDataFrame([(0,), (4,), (5,), (10,), (21,)], "tx long")
    assert rows(tp.block_of(t, b)) == [(0, 0), (4, 0), (5, 1), (10, 5)]
    assert rows(tp.block_gaps(b)) == [(5, 2)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 12), st.one_of(st.none(), st.integers(0, 3))), max_size=25, unique_by=lambda x: x[:2]), st.integers(0, 13))
def test_random_logs(spark, data, at):
    df = spark.createDataFrame(data, "k long, tx long, v long")
    state = {}
    for k, tx, v in sorted(data, key=lambda x: x[1]):
        if tx < at:
            state[k] = v
    want = sorted((k, v) for k, v in state.items() if v is not None)
    assert rows(tp.as_of(df, at)) == want
    assert rows(tp.as_of_by_history(tp.history(df), at)) == want


# sets of numbers, loading, overlays


def test_fixed_bitmaps(spark):
    sets = {0: [3, 9, 11], 1: [1, 2, 3], 2: [4, 8, 13], 3: [1, 13], 6: [0, 9, 13], 7: [7]}
    df = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "k long, file long")
    assert (2, 8, 13) in rows(ix.first_two_from(df, 8)) and (7, 7, None) in rows(ix.first_two_from(df, 0))
    sh = ix.to_shards(df.withColumnRenamed("file", "tx"), 8)
    assert rows(ix.from_shards(sh)) == sorted((k, v) for k, vs in sets.items() for v in vs)
    assert rows(ix.from_shards(ix.clipped(sh, 3, 9, 8))) == sorted((k, v) for k, vs in sets.items() for v in vs if 3 <= v < 9)
    assert rows(ix.from_shards(ix.chunk_by_size(sh, 1))) == rows(ix.from_shards(sh))


def test_duplicate_policies(spark):
    r = spark.createDataFrame([("b", "2", 1), ("a", "1", 2), ("b", "3", 3), ("b", None, 4)], "k string, v string, seq long")
    assert rows(etl.load_appended(r, "seq", "-")) == [("a", "1"), ("b", "2-3")]
    assert rows(etl.load_oldest(r, "seq")) == [("a", "1"), ("b", "2")]
    assert [x.v for x in etl.sort_stable(r, "seq").collect()] == ["1", "2", "3", None]
    t = spark.createDataFrame([("a", "x"), ("c", "y")], "k string, v string")
    one = spark.createDataFrame([("a", None), ("b", "new"), ("c", "z")], "k string, v string")
    assert rows(etl.load_onto(t, one)) == [("b", "new"), ("c", "z")]
    assert rows(etl.load_onto(t, one, F.concat(F.coalesce("old", F.lit("")), "v"))) == [("b", "new"), ("c", "yz")]
    assert rows(etl.extract(t, "b", outputs=[F.struct("k", "v"), F.when(F.col("v") == "x", F.struct("k", "v"))])) == [("c", "y")]


def test_overlay_diff_round_trip(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k long, v string")
    d = overlay.diff(old, new)
    assert rows(d) == [(1, "delete", None), (2, "update", "c"), (4, "insert", "d")]
    assert rows(overlay.apply_diff(old, d)) == rows(new)
    m = spark.createDataFrame([(1, "put", 1, "x"), (2, "delete", 1, None), (3, "delete", 2, None), (4, "put", 2, "y")], "seq long, op string, k long, v string")
    puts, gone = overlay.compact_mutations(m)
    assert rows(overlay.read_through(old, puts, gone)) == [(2, "y"), (3, None)]
    assert rows(overlay.read_through(old, puts, gone, cleared=True)) == [(2, "y")]


# word files, pools


def test_longest_matches(spark):
    t = spark.createDataFrame([(1, "the catalogue cat"), (2, ""), (3, None), (4, "x" * 300_000 + "cat")], "id long, t string")
    p = spark.createDataFrame([("cat",), ("catalog",), ("log",), ("",), (None,), ("ogue",), ("cat",)], "p string")
    got = rows(formats.longest_matches(t, p, text_id="id", text="t", pattern="p"))
    assert got == [(1, 4, 11, "catalog"), (1, 9, 13, "ogue"), (1, 14, 17, "cat"), (4, 300_000, 300_003, "cat")]
    assert formats.longest_matches(t, p.limit(0), text_id="id", text="t", pattern="p").count() == 0


def test_word_files_and_offsets(spark, tmp_path):
    w = spark.createDataFrame([(i, f"w{i % 3}") for i in range(20)], "n long, word string")
    formats.write_words(w, str(tmp_path / "w"))
    assert rows(formats.read_words(spark, str(tmp_path / "w"), 15)) == rows(w.where("n >= 15"))
    e = spark.createDataFrame([(5, 2), (1, 3), (9, 4)], "k long, size int")
    assert rows(formats.offset_index(e, "size")) == [(1, 0, 0), (5, 1, 3), (9, 2, 5)]
    with pytest.raises(Exception, match="repeated key"):
        formats.offset_index(e.union(e), "size").collect()


def test_greedy_pick(spark):
    r = random.Random(0)
    data = [(i, r.randint(0, 20), r.randint(1, 40)) for i in range(300)]
    left, want = 200, []
    for i, tip, cost in sorted(data, key=lambda d: (-d[1], -d[0])):
        if cost <= left and len(want) < 12:
            want.append(i)
            left -= cost
    df = spark.createDataFrame(data, "id long, tip long, gas long")
    got = pool.pick_greedily(df, order=["tip", "id"], cost="gas", budget=200, most=12, chunk=17)
    assert [x.id for x in got.collect()] == want
    assert pool.pick_greedily(df.limit(0), order=["tip", "id"], cost="gas", budget=9, most=9).count() == 0


def test_pool_rows(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 7), (2, 9, 1), (None, 3, 1)], "who long, n long, id long")
    assert rows(pool.drop_upper_half(df, "who", "n", "id").select("id")) == [(1,), (1,), (5,), (6,)]
    assert rows(pool.without_done(df, df.where("n = 1"), "who", "n").select("id")) == [(1,), (1,), (7,)]
    assert rows(pool.keep_best(df, "who", [F.desc("n")], 1).select("id")) == [(1,), (1,), (7,)]
    assert rows(pool.dense_ids(df, "who")) == [(1, 1), (2, 2)]
    run = pool.running_conditions(df.withColumn("base", F.lit(1)), owner="who", number="n", base="base", sums={"s": "id"}, mins={"m": "id"})
    assert [(r.s, r.m, r.no_gap) for r in run.where("who = 1").orderBy("n").collect()] == [(6, 6, True), (13, 6, True)]


# codecs and trees


def test_keccak_and_rlp():
    assert keccak256([b""])[0].hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256([b"abc", b"x" * 136, b"abc"])[0] == keccak256([b"abc"])[0]
    assert rlp.encode([b"cat", b"dog"]).hex() == "c88363617483646f67" and rlp.encode(b"\x0f") == b"\x0f" and rlp.encode([]) == b"\xc0"
    for bad in ("81", "8100", "b800", "c3", "c88363617483646f6700"):
        with pytest.raises(ValueError):
            rlp.decode(bytes.fromhex(bad))


@given(st.recursive(st.binary(max_size=80), lambda x: st.lists(x, max_size=5), max_leaves=20))
def test_rlp_round_trip(item):
    assert rlp.decode(rlp.encode(item)) == item


#: Accounts of a public test network's first block with their balances, and its root.
GENESIS = {a: int(b, 16) for a, b in map(str.split, """
a2a6d93439144ffe4d27c9e088dcd8b783946263 00d3c21bcecceda1000000
bc11295936aa79d594139de1b2e12629414f3bdb 00d3c21bcecceda1000000
7cf5b79bfe291a67ab02b393e456ccc4c266f753 00d3c21bcecceda1000000
aaec86394441f915bce3e6ab399977e9906f3b69 00d3c21bcecceda1000000
f47cae1cf79ca6758bfc787dbd21e6bdbe7112b8 00d3c21bcecceda1000000
d7eddb78ed295b3c9629240e8924fb8d8874ddd8 00d3c21bcecceda1000000
8b7f0977bb4f0fbe7076fa22bc24aca043583f5e 00d3c21bcecceda1000000
e2e2659028143784d557bcec6ff3a0721048880a 00d3c21bcecceda1000000
d9a5179f091d85051d3c982785efd1455cec8699 00d3c21bcecceda1000000
beef32ca5b9a198d27b4e02f4c70439fe60356cf 00d3c21bcecceda1000000
0000006916a87b82333f4245046623b23794c65c 084595161401484a000000
b21c33de1fab3fa15499c62b59fe0cc3250020d1 52b7d2dcc80cd2e4000000
10f5d45854e038071485ac9e402308cf80d2d2fe 52b7d2dcc80cd2e4000000
d7d76c58b3a519e9fa6cc4d22dc017259bc49f1e 52b7d2dcc80cd2e4000000
799d329e5f583419167cd722962485926e338f4a 0000000de0b6b3a7640000
""".strip().splitlines())}
GENESIS_ROOT = "5eb6e371a698b8d68f665192350ffcecbbbf322916f4b51bd79bb6887da3f494"


@pytest.mark.parametrize("depth", [0, 3])
def test_state_root(spark, depth):
    df = spark.createDataFrame([(bytes.fromhex(a), 0, str(b)) for a, b in GENESIS.items()], "k binary, nonce long, balance string")
    values = df.select("k", commitment.account_value("nonce", "balance").alias("v"))
    assert rows(commitment.state_root(values, depth)) == [(GENESIS_ROOT,)]
    if depth:
        one = values.where(F.hex("k") == "A2A6D93439144FFE4D27C9E088DCD8B783946263")
        assert commitment.state_root(one, depth).first()[0] == commitment.state_root(one).first()[0] != GENESIS_ROOT
        assert rows(commitment.state_root(values.limit(0), depth)) == [(commitment.EMPTY_ROOT.hex(),)]


def test_codecs(spark):
    df = spark.createDataFrame([(0, "0x", b""), (255, "0xAbcd", b"\x01\x02"), (2**40, "abc", b"\xff" * 40), (None, None, None)], "x long, s string, b binary")
    got = df.select(codec.u64_hex(F.col("x")), codec.hex_decode(F.col("s")), F.length(codec.to_width(F.col("b"), 32)), codec.byte_count(F.col("x"))).collect()
    assert [r[0] for r in got] == ["0" * 16, "00000000000000ff", "0000010000000000", None]
    assert [r[1] for r in got] == [None, b"\xab\xcd", None, None]
    assert [r[2] for r in got] == [32, 32, 32, None] and [r[3] for r in got] == ["0 B", "255 B", "1.0 TB", None]
    n = spark.createDataFrame([("18446744073709551615", "1"), ("5", "6"), ("4294967296", "4294967296")], "a string, b string").select(F.col("a").cast("decimal(20,0)").alias("a"), F.col("b").cast("decimal(20,0)").alias("b"))
    assert [r[0] if r[0] is None else int(r[0]) for r in n.select(codec.safe_add(F.col("a"), F.col("b"))).collect()] == [None, 11, 2**33]
    assert [r[0] if r[0] is None else int(r[0]) for r in n.select(codec.safe_mul(F.col("a"), F.col("b"))).collect()] == [2**64 - 1, 30, None]


def test_account_round_trip(spark):
    df = spark.createDataFrame([(0, "0"), (7, str(10**30)), (None, "1"), (2, None)], "n long, b string")
    got = df.select("n", "b", decode_account(encode_account("n", "b")).alias("x")).select("n", "b", "x.*").collect()
    assert [(r.nonce, r.balance) for r in got] == [(0, "0"), (7, str(10**30)), (None, None), (None, None)]
    bad = spark.createDataFrame([(b"\x05\x01",), (b"",), (None,)], "d binary")
    assert [tuple(r[0]) for r in bad.select(decode_account("d")).collect()] == [(None, None)] * 3


def test_branch_masks(spark):
    up = spark.createDataFrame([(1, "p", 0, "x"), (2, "p", 0, None), (3, "p", 4, "y")], "seq long, prefix string, nibble int, cell string")
    assert rows(commitment.merge_branches(up)) == [("p", 0b10001, 0b10000)]


def test_transform_takes_the_last_by_seq(spark):
    target = spark.createDataFrame([(1, 9), (2, 8)], "k long, v long")
    for data in ([(1, 0, 1), (1, 7, 2)], [(1, 7, 2), (1, 0, 1)]):
        src = spark.createDataFrame(data, "k long, v long, seq long")
        assert rows(etl.transform(src, target, outputs=[F.struct("k", "v")], seq="seq")) == [(1, 7), (2, 8)]
    both = [F.struct("k", F.lit(5).cast("long").alias("v")), F.struct("k", F.lit(6).cast("long").alias("v"))]
    assert rows(etl.transform(src.limit(1), target, outputs=both, seq="seq")) == [(1, 6), (2, 8)]


@pytest.mark.parametrize("most", [1, 12, 10**6])
def test_longest_matches_over_blocks(spark, most, monkeypatch):
    monkeypatch.setattr(formats, "BLOCK_CHARS", most)
    r = random.Random(6)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 6))) for _ in range(25)]
    texts = [(i, "".join(r.choice("abc") for _ in range(r.randint(0, 30)))) for i in range(20)] + [(99, None)]
    want = []
    for i, t in texts:
        reached = 0
        for a in range(len(t or "")):
            z = max((a + len(w) for w in words if t.startswith(w, a)), default=0)
            if z > reached:
                reached = z
                want.append((i, a, z, t[a:z]))
    got = formats.longest_matches(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(w,) for w in [*words, "", None]], "p string"), text_id="id", text="t", pattern="p")
    assert rows(got) == sorted(want)
