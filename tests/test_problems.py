"""Operators of problems 1 to 6 against plain models: nulls, ties, repeats, empty tables, heavy keys cut into shards."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from chronolake.operators.asof import as_known_at
from chronolake.operators.cuckoo import CuckooFilter, ask_filters, seen_before, update_filters
from chronolake.operators.intervals import periods_and_gaps
from chronolake.operators.ledger import Ledger, assign_gaps, merge_intervals, new_or_changed, pending, run_gaps, runs_of, sequence_of
from chronolake.operators.merkle import SnapshotHistory, history_from_snapshots
from chronolake.operators.salted import add_salt, index_entries

EVENTS, VERSIONS = "recon_id long, k long, tx_num long, hist_id string", "hist_id long, k long, tx_num long, known_tx long, v long"


def asof(ev, ve, **kw):
    return as_known_at(ev.withColumnRenamed("tx_num", "at"), ve, key="k", event_time="at", order=["tx_num", "known_tx", "hist_id"], available=["tx_num", "known_tx"], prefix="of_", **kw)


@pytest.mark.parametrize("hot_rows", [10**9, 40, 7])
def test_asof_against_model(spark, hot_rows):
    r = random.Random(5)
    key = lambda: 1 if r.random() < 0.4 else r.choice([None, 2, 3, 4, 5])
    tx = lambda: 50 if r.random() < 0.3 else r.randint(0, 100)
    versions = [(i, key(), r.choice([None, tx(), tx(), tx(), tx()]), tx(), r.choice([None, i])) for i in range(200)]
    events = [(i, key(), r.choice([None, tx(), tx(), tx()]), "clash") for i in range(200)] + [(7, 1, 50, "clash")] * 30
    want = []
    for e in events:
        can = [v for v in versions if None not in (e[1], e[2], v[1], v[2]) and v[1] == e[1] and v[2] <= e[2] and v[3] <= e[2]]
        if can:
            want.append((e[0], max(can, key=lambda v: (v[2], v[3], v[0]))[0]))
    ev, ve = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
    assert rows(asof(ev, ve, hot_rows=hot_rows).select("recon_id", "of_hist_id")) == sorted(want)
    assert asof(ev, ve, how="left", hot_rows=hot_rows).count() == len(events)


def test_asof_edges(spark):
    ev, ve = spark.createDataFrame([(1, 1, 5, "x")], EVENTS), spark.createDataFrame([(1, 1, 5, 9, 0)], VERSIONS)
    assert rows(asof(ev, ve)) == []  # valid, but not known yet
    assert asof(ev.limit(0), ve).count() == 0 and asof(ev, ve.limit(0)).count() == 0
    assert asof(ev, ve.limit(0), how="left").count() == 1
    with pytest.raises(ValueError, match="clash"):
        as_known_at(ev, ve, key="k", event_time="tx_num", order=["hist_id"], available=["known_tx"])


@pytest.mark.parametrize("hot_rows", [10**9, 30, 5])
def test_periods_against_model(spark, hot_rows):
    r = random.Random(8)
    data = [("a" if r.random() < 0.6 else r.choice(["b", "c", None]), r.choice([None, *[r.randint(0, 400)] * 9]), 0, i) for i in range(250)]
    data = [(e, s, r.choice([None, *[(s or 0) + r.randint(-1, 4)] * 9]) if r.random() < 0.97 else (s or 0) + 60, i) for e, s, _, i in data]
    got = rows(periods_and_gaps(spark.createDataFrame(data, "e string, s long, f long, kind long"), entity="e", start="s", end="f", hot_rows=hot_rows))
    want = []
    for e in "abc":
        covered = sorted({x for ee, s, f, _ in data if ee == e and s is not None and f is not None for x in range(s, f)})
        runs = []
        for x in covered:
            if runs and runs[-1][1] == x:
                runs[-1][1] = x + 1
            else:
                runs.append([x, x + 1])
        want += [(e, "period", a, b) for a, b in runs] + [(e, "gap", p[1], q[0]) for p, q in zip(runs, runs[1:])]
    assert got == sorted(want)


def test_periods_touching_and_empty(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 5, 7), ("a", 9, 9), ("a", 8, 7)], "e string, s long, f long")
    assert rows(periods_and_gaps(df, entity="e", start="s", end="f")) == [("a", "period", 0, 7)]
    assert periods_and_gaps(df.limit(0), entity="e", start="s", end="f").count() == 0


LOG = "change_id long, k long, tx_num long, v long, arrived_at timestamp, run_id string"


def at(n):
    return dt.datetime(2028, 1, 1) + dt.timedelta(seconds=n) if n is not None else None


def test_new_or_changed_against_model(spark):
    r = random.Random(3)
    log = [(i, r.choice([1, 1, 2, None]), r.choice([4, 4, 4, 5, None]), r.choice([None, 1, 2]), at(r.choice([None, *range(40)])), "x") for i in range(300)]
    runs = [(i, at(c), s) for i, (c, s) in enumerate([(5, "ok"), (9, "failed"), (20, "ok"), (20, "ok"), (None, "ok"), (12, "ok"), (33, "ok")])]
    rf = spark.createDataFrame(runs, "run_id long, cutoff_at timestamp, status string")
    gaps = run_gaps(rf, run_id="run_id", cutoff="cutoff_at", ok=F.col("status") == "ok").withColumnRenamed("run_id", "run")
    got = rows(new_or_changed(spark.createDataFrame(log, LOG), gaps, record=["k", "tx_num"], seq=sequence_of(F.col("arrived_at")), tie="change_id", values=["v"], keep=["change_id"]).select("run", "change_id"))
    want, last, before = [], {}, None
    for run, cut, _ in sorted((x for x in runs if x[2] == "ok" and x[1]), key=lambda x: (x[1], x[0])):
        seen = defaultdict(list)
        for c in log:
            if c[4] and c[4] <= cut and (before is None or c[4] > before):
                seen[c[1], c[2]].append(c)
        for rec, found in seen.items():
            c = max(found, key=lambda c: (c[4], c[0]))
            if rec not in last or last[rec] != c[3]:
                want.append((run, c[0]))
            last[rec] = c[3]
        before = cut
    assert got == sorted(want)


def test_record_delivered_very_often(spark, monkeypatch):
    from chronolake.operators import ledger
    from chronolake.plans import skew

    log = [(i, 1, 4, 7, at(i % 60), "x") for i in range(900)] + [(2000 + i, i % 50, i % 3, i % 2, at(i % 60), "x") for i in range(300)]
    rf = spark.createDataFrame([(1, at(20)), (2, at(70))], "run_id long, cutoff_at timestamp")
    gaps = run_gaps(rf, run_id="run_id", cutoff="cutoff_at", ok=F.lit(True)).withColumnRenamed("run_id", "run")
    how = dict(record=["k", "tx_num"], seq=sequence_of(F.col("arrived_at")), tie="change_id", values=["v"], keep=["change_id"])
    want = rows(new_or_changed(spark.createDataFrame(log, LOG), gaps, **how))
    monkeypatch.setattr(ledger, "heavy_keys", lambda df, key: skew.heavy_keys(df, key, 100))
    assert rows(new_or_changed(spark.createDataFrame(log, LOG), gaps, **how)) == want and len(want) > 60


def test_no_runs(spark):
    rf = spark.createDataFrame([], "run_id long, cutoff_at timestamp, status string")
    gaps = run_gaps(rf, run_id="run_id", cutoff="cutoff_at", ok=F.lit(True))
    log = spark.createDataFrame([(1, 1, 1, 1, at(1), "x")], LOG).withColumn("seq", F.lit(5))
    assert assign_gaps(log.drop("run_id"), "seq", gaps).count() == 0


def test_ledger_takes_each_number_once(spark, tmp_path):
    led, source = Ledger(spark, str(tmp_path / "ledger")), lambda *n: spark.createDataFrame([(x,) for x in n], "seq long")
    assert led.output() is None and rows(led.processed()) == []
    assert led.run(source(1, 2, 3, 7, None), "seq", lambda d: d) == 1
    assert rows(led.processed()) == [(1, 4), (7, 8)]

    def dies(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        led.run(source(1, 2, 3, 4, 7, 9), "seq", dies)
    assert led.manifest()["version"] == 1 and sorted(r[0] for r in led.output().collect()) == [1, 2, 3, 7]
    assert led.run(source(1, 2, 3, 4, 5, 6, 7, 9), "seq", lambda d: d) == 2  # late numbers fill the gap
    assert rows(led.processed()) == [(1, 8), (9, 10)]
    assert led.run(source(1, 2, 3, 4, 5, 6, 7, 9), "seq", lambda d: d) is None
    assert sorted(r[0] for r in led.output().collect()) == [1, 2, 3, 4, 5, 6, 7, 9]
    with pytest.raises(RuntimeError, match="another run"):
        led._commit(1, {})


def test_ledger_run_that_dies_after_its_output(spark, tmp_path, monkeypatch):
    led, source = Ledger(spark, str(tmp_path / "ledger")), spark.createDataFrame([(x,) for x in (4, 5, 9)], "seq long")

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(led, "_commit", dies)
        with pytest.raises(RuntimeError):
            led.run(source, "seq", lambda d: d)
    assert led.output() is None and rows(led.processed()) == []
    assert led.run(source, "seq", lambda d: d) == 1
    assert rows(led.processed()) == [(4, 6), (9, 10)] and sorted(r[0] for r in led.output().collect()) == [4, 5, 9]


def test_manifest_of_a_dead_writer_is_passed_over(spark, tmp_path, monkeypatch):
    from chronolake.sources import manifest

    m = manifest.Manifests(spark, str(tmp_path / "m"), "v")
    assert m.last() == (0, None) and m.publish(0, {"a": 1}) == 1
    (tmp_path / "m" / "v-0000000002.json").write_text("")
    with pytest.raises(RuntimeError, match="another run"):
        m.publish(1, {"a": 2})
    monkeypatch.setattr(manifest, "GIVEN_UP", -1.0)
    assert m.publish(1, {"a": 2}) == 3 and m.last() == (3, {"a": 2}) and m.versions() == [1, 3]
    with pytest.raises(RuntimeError, match="another run"):
        m.publish(1, {"a": 9})


def test_long_intervals_cost_nothing(spark):
    done = spark.createDataFrame([(3, 10**13), (2 * 10**13, 10**18)], "lo long, hi long")
    src = spark.createDataFrame([(2,), (3,), (10**13 - 1,), (10**13,), (10**18 - 1,), (10**18,)], "seq long")
    assert rows(pending(src, "seq", done)) == [(2,), (10**13,), (10**18,)]


@pytest.mark.parametrize("most", [0, 10**6])
def test_locate_against_model(spark, most, monkeypatch):
    from chronolake.operators import ledger

    monkeypatch.setattr(ledger, "MAX_BROADCAST_INTERVALS", most)
    r = random.Random(9)
    edges = sorted(r.sample(range(400), 60)) + [10**15, 10**15 + 7]
    iv = [(a, b, f"g{a}") for a, b in zip(edges[::2], edges[1::2])]
    src = [(i, r.choice([None, 10**15 + 3, 10**16, *[r.randint(-5, 405)] * 9])) for i in range(300)]
    df, gaps = spark.createDataFrame(src, "i long, seq long"), spark.createDataFrame(iv, "a long, z long, name string")
    met = {i: [g for g in iv if n is not None and g[0] <= n < g[1]] for i, n in src}
    assert rows(ledger.locate(df, "seq", gaps, lo="a", hi="z").select("i", "name", "a", "z")) == sorted((i, g[2], g[0], g[1]) for i, m in met.items() for g in m)
    assert rows(ledger.locate(df, "seq", gaps, lo="a", hi="z", outside=True)) == sorted((i, n) for i, n in src if n is not None and not met[i])
    assert ledger.locate(df, "seq", gaps.limit(0), lo="a", hi="z").count() == 0


def test_runs_of_numbers(spark):
    numbers = [5, 5, 6, 7, 9, *range(100, 25_000), None, -3]
    found = runs_of(spark.createDataFrame([(n,) for n in numbers], "n long"), "n")
    assert rows(merge_intervals(found)) == [(-3, -2), (5, 8), (9, 10), (100, 25_000)] and found.count() < 12
    assert runs_of(spark.createDataFrame([], "n int"), "n").count() == 0


def test_intervals_of_numbers(spark):
    iv = spark.createDataFrame([(0, 5), (5, 6), (9, 9), (None, 3), (20, 9000)], "lo long, hi long")
    assert rows(merge_intervals(iv)) == [(0, 6), (20, 9000)]
    src = spark.createDataFrame([(-1,), (0,), (5,), (6,), (4096,), (9000,), (None,)], "seq long")
    assert rows(pending(src, "seq", iv.where("lo is not null"))) == [(-1,), (6,), (9000,)]


SNAP = "row_id long, address string, tx_num long, nonce long, balance decimal(38,0), code_hash string, key string"


@pytest.mark.parametrize("rows_in_leaf", [1, 1000])
def test_snapshot_history_against_model(spark, rows_in_leaf):
    r = random.Random(rows_in_leaf)
    snaps = [(10 * i, r.random() < 0.7) for i in range(1, 9)]
    data, n = [], 0
    for a in range(60):
        value = (1, None, None)
        for t, whole in snaps:
            if r.random() < 0.15:
                value = (r.randint(1, 3), r.choice([None, 5]), r.choice([None, "c"]))
            if r.random() < 0.85:
                for _ in range(r.choice([1, 1, 2])):
                    n += 1
                    data.append((n, r.choice(["0xA", "0xa"]) + str(a), t, *value, "clash"))
        data.append((1000 + a, f"0xa{a}", None, 9, None, None, "clash"))
    data.append((5000, None, 10, 1, None, None, "clash"))
    state, want = {}, []
    for a in sorted({d[1].lower() for d in data if d[1]}):
        open_ = None
        for t, whole in snaps:
            here = [d for d in data if d[1] and d[1].lower() == a and d[2] == t]
            now = max(here, key=lambda d: d[0])[3:6] if here else None
            if now is None and not whole:
                continue
            if open_ and now != open_[1]:
                want.append((a, open_[0], t))
                open_ = None
            if now and not open_:
                open_ = (t, now)
        if open_:
            want.append((a, open_[0], -1))
    got = history_from_snapshots(
        spark.createDataFrame([(*d[:4], None if d[4] is None else __import__("decimal").Decimal(d[4]), *d[5:]) for d in data], SNAP),
        spark.createDataFrame(snaps, "tx_num long, complete boolean"), key=F.lower("address"), at="tx_num", tie="row_id", values=["nonce", "balance", "code_hash"], rows_in_leaf=rows_in_leaf,
    )
    assert rows(got.select("key", "valid_from", "valid_to")) == sorted(want)
    assert state == {}


def test_snapshot_history_empty(spark):
    e, s = spark.createDataFrame([], SNAP), spark.createDataFrame([(1, True)], "tx_num long, complete boolean")
    kw = dict(key=F.lower("address"), at="tx_num", tie="row_id", values=["nonce"])
    assert history_from_snapshots(e, s, **kw).count() == 0
    assert history_from_snapshots(e, s.limit(0), **kw).count() == 0


@pytest.mark.parametrize("hot_rows", [10**9, 20])
def test_index_entries(spark, hot_rows):
    r = random.Random(1)
    data = [(7 if r.random() < 0.5 else r.choice([None, 1, 2]), r.choice([None, *range(60)])) for _ in range(400)] + [(9, None)]
    by = defaultdict(set)
    for k, t in data:
        if k is not None:
            by[k] |= {t} - {None}
    want = sorted((k, len(t), min(t, default=None), max(t, default=None)) for k, t in by.items())
    df = spark.createDataFrame(data, "k long, n_tx long")
    assert rows(index_entries(df, key="k", time="n_tx", hot_rows=hot_rows)) == want
    if hot_rows == 20:
        spread = add_salt(df, "k", F.col("n_tx"), salts=8, hot_rows=hot_rows)
        assert spread.where("k = 7").select("__salt").distinct().count() > 1
        assert rows(spread.where("k is null or k = 9").select("__salt").distinct()) == [(0,)]
    assert index_entries(df.limit(0), key="k", time="n_tx").count() == 0


def test_cuckoo_filter_never_forgets():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**64, 60_000, dtype=np.uint64)
    f = CuckooFilter(log2_buckets=6)
    for part in np.array_split(keys, 37):
        f.seen_then_add(part)
    assert f.has(keys).all() and len(f.tables) > 3
    assert f.has(rng.integers(0, 2**64, 60_000, dtype=np.uint64)).mean() < 0.01


def test_cuckoo_filter_deletes():
    keys = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    f = CuckooFilter(log2_buckets=8)
    f.add(keys)
    assert all(f.remove(k) for k in keys[:250])
    assert f.has(keys[250:]).all() and f.has(keys[:250]).mean() < 0.02
    assert f.seen_then_add(np.array([5, 6, 5], np.uint64)).tolist() == [False, False, True]


@pytest.mark.parametrize("hot_rows", [10**9, 30])
@pytest.mark.parametrize("buckets", [0, 12])
def test_seen_before(spark, hot_rows, buckets):
    r = random.Random(2)
    data = [(i, None if r.random() < 0.1 else b"hot" if r.random() < 0.3 else bytes([r.randint(0, 90)]) * r.choice([0, 1, 4]), True) for i in range(400)]
    r.shuffle(data)
    seen, want = set(), []
    for i, h, _ in sorted(data):
        if h is not None:
            if h in seen:
                want.append((i,))
            seen.add(h)
    df = spark.createDataFrame(data, "arrival_id long, id_hash binary, said boolean")
    got = seen_before(df, key="id_hash", order="arrival_id", log2_buckets=buckets, hot_rows=hot_rows)
    assert rows(got.where("repeat").select("arrival_id")) == want
    assert got.where("repeat and not said").count() == 0
    assert got.count() == sum(h is not None for _, h, _ in data)


def test_seen_before_empty_and_spread(spark):
    df = spark.createDataFrame([(i, b"x") for i in range(200)], "arrival_id long, id_hash binary")
    assert seen_before(df.limit(0), key="id_hash", order="arrival_id").count() == 0
    flags = seen_before(df, key="id_hash", order="arrival_id", hot_rows=50)
    assert flags.where("not raw").count() > 1 and flags.where("not said").count() == 1


def test_small_buckets(spark):
    data = [(i, f"key {i % 700}".encode(), "clash") for i in range(2000)]
    df = spark.createDataFrame(data, "arrival_id long, id_hash binary, raw string")
    got = seen_before(df, key="id_hash", order="arrival_id", bucket_rows=40, log2_buckets=2)
    assert rows(got.where("repeat").select("arrival_id")) == [(i,) for i in range(700, 2000)] and got.count() == 2000


def test_kept_filters(spark):
    keys = lambda *n: spark.createDataFrame([(f"k{i}".encode() if i is not None else None, i) for i in n], "id_hash binary, bucket int")
    kept = update_filters(None, keys(*range(500), None, 3, 3), key="id_hash", bits=3, log2_buckets=2)
    kept = update_filters(kept, keys(*range(100), 3, None), key="id_hash", remove=True, bits=3)
    asked = keys(*range(600), None, 3)
    got = {r.bucket for r in ask_filters(kept, asked, key="id_hash", bits=3).collect()}
    assert got >= {*range(100, 500)} and len(got) < 415 and None not in got
    kept = update_filters(kept, keys(3), key="id_hash", bits=3)
    assert ask_filters(kept, keys(3, 3), key="id_hash", bits=3).count() == 2
    assert update_filters(None, keys().limit(0), key="id_hash").count() == 0
    assert ask_filters(kept.limit(0), keys(1), key="id_hash").count() == 0


def test_filters_come_back_from_bytes():
    f = CuckooFilter(log2_buckets=3)
    h = np.random.default_rng(3).integers(0, 2**64, 4000, dtype=np.uint64)
    f.add(h)
    g = CuckooFilter.loads(f.dumps())
    assert g.has(h).all() and len(g.tables) == len(f.tables) > 2 and g.remove(h[0]) and not f.tables[0].cells is g.tables[0].cells
    g.add(h[:1])
    assert [t.n for t in g.tables] == [t.n for t in f.tables] or g.has(h[:1]).all()


def test_snapshots_appended_one_by_one(spark, tmp_path):
    r = random.Random(21)
    taken = [(t, r.random() < 0.6) for t in sorted(r.sample(range(100), 9))]
    data = [(i, r.choice([None, *"abcdefgh"]), t, r.choice([None, 1, 2])) for i in range(4) for t, _ in taken for _ in range(6)]
    data = [(n, *x[1:]) for n, x in enumerate(data)]
    df = spark.createDataFrame(data, "row_id long, address string, at long, v long")
    want, live = [], {}
    for t, complete in taken:
        seen = {}
        for n, a, tt, v in data:
            if tt == t and a:
                seen[a] = v
        for a in [*live]:
            if (a in seen and seen[a] != live[a][1]) or (complete and a not in seen):
                want.append((a, live[a][0], t, live.pop(a)[1]))
        for a, v in seen.items():
            live.setdefault(a, (t, v))
    want += [(a, t, -1, v) for a, (t, v) in live.items()]
    h = SnapshotHistory(spark, str(tmp_path / "h"), key="address", values=["v"], tie="row_id", leaves=40)
    assert h.versions() is None
    for t, complete in taken:
        h.append(df.where(F.col("at") == t).drop("at"), t, complete)
    none_first = lambda x: sorted(x, key=str)
    assert none_first(tuple(x) for x in h.versions().collect()) == none_first(want)
    with pytest.raises(ValueError, match="later"):
        h.append(df, taken[-1][0])
    runs = spark.createDataFrame(taken, "at long, complete boolean")
    whole = history_from_snapshots(df, runs, key=F.col("address"), at="at", tie="row_id", values=["v"])
    assert none_first(tuple(x) for x in whole.collect()) == none_first(want)
