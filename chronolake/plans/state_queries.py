"""Queries over what is kept between runs: stores, logs that wait, trees, pools, pages; and over suffixes and covers."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolake.functions import accounts, codec, lists, rlp, transactions
from chronolake.operators import commitment, etl, formats, kv, overlay, pool, streams
from chronolake.operators import index as ix
from chronolake.operators import lifecycle as lc
from chronolake.operators import temporal as tp
from chronolake.plans.core_queries import CU, EV, HI, OP, customers, events, order_pairs
from chronolake.plans.more_queries import FI, SLOT, STEP, file_ranges, slots, txs
from chronolake.plans.registry import core
from chronolake.session import shared_dir, table
from chronolake.sources import pages
from chronolake.sources.catalog import Catalog
from chronolake.sources.store import VersionedTable
from chronolake.streaming.fetch import Fetch

query = core.query
HALF = f"(SELECT max(tx) // 2 FROM {EV})"


def fresh(s: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def half(s, d) -> int:
    return events(s, d).agg(F.max("tx")).first()[0] // 2


# walks and stores ---------------------------------------------------------------------------------------------------------


@query("r10_big_chunks", f"SELECT k, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM {OP} GROUP BY k")
def _(s, d):
    """A long walk in parts, each summed up and committed on its own."""
    at = fresh(s, "walk")
    for i, part in enumerate(kv.chunks(order_pairs(s, d), 5)):
        part.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")).write.parquet(f"{at}/part={i}")
    return s.read.parquet(at).drop("part")


@query("r11_read_ahead", f"SELECT k, v FROM {OP} WHERE k >= 100 ORDER BY k, v LIMIT 500")
def _(s, d):
    return kv.read_ahead(order_pairs(s, d), 100, 500)


@query("w5_versions", f"SELECT 1 AS version, k, v FROM {CU} UNION ALL SELECT 2, k, CASE WHEN k % 2 = 0 THEN v + 1 ELSE v END FROM {CU}")
def _(s, d):
    """Two versions of a table: the first stays as it was for its readers, and a writer that comes too late is refused."""
    store = VersionedTable(s, fresh(s, "store"))
    store.commit(customers(s, d))
    first = store.view()
    store.update(lambda t: t.withColumn("v", F.when(F.col("k") % 2 == 0, F.col("v") + 1).otherwise(F.col("v"))))
    try:
        store.commit(first.limit(0), after=1)
        raise AssertionError("a late writer was let in")
    except RuntimeError:
        pass
    return first.select(F.lit(1).alias("version"), "k", "v").unionByName(store.view().select(F.lit(2).alias("version"), "k", "v"))


@query("k18_catalog", f"SELECT 'cleared' AS name, 0 AS n UNION ALL SELECT 'kept', (SELECT count(*) FROM {CU})")
def _(s, d):
    """Declared tables that are written, cleared and dropped: those that exist in the end, with their rows."""
    c = customers(s, d)
    cat = Catalog(s, fresh(s, "catalog"), dict.fromkeys(["kept", "cleared", "old", "never"], c.schema), deprecated=["old"])
    for name in ("kept", "cleared", "old"):
        cat.create(name)
        cat.write(name, c)
    cat.clear("cleared")
    cat.drop("old")
    found = [cat.view(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in cat.names()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("x8_put_index", f"SELECT DISTINCT 'user' AS name, CAST(k AS VARCHAR) AS k, tx FROM {EV}")
def _(s, d):
    ev, at = events(s, d), half(s, d)
    early = ix.build(ev.where(F.col("tx") < at), user="k")
    return ix.put(early, ev.where(F.col("tx") >= at - 100).select(F.lit("user").alias("name"), "k", "tx"))


# the life of a log ----------------------------------------------------------------------------------------------------------


@query(
    "c3_collate_oldest",
    f"""WITH h AS (SELECT k, tx, v, tx // 1000 AS step FROM {EV} WHERE tx >= {HALF}), o AS (SELECT k, min(step) AS step FROM h GROUP BY k)
    SELECT o.step, o.k, arg_max_null(h.v, h.tx) AS v FROM o JOIN h ON h.k = o.k AND h.step = o.step GROUP BY ALL""",
)
def _(s, d):
    return lc.collate_oldest(events(s, d).where(F.col("tx") >= half(s, d)), STEP)


@query("c5_missed_indices", f"SELECT tx // 1000 AS step, k, count(DISTINCT tx) AS n, min(tx) AS first_tx, max(tx) AS last_tx FROM {EV} GROUP BY 1, 2")
def _(s, d):
    """Step files of which every second one has its index; the others are built. A second call finds none missing."""
    at, log = fresh(s, "steps"), events(s, d).select("k", "tx", "v").withColumn("step", lc.step_of(STEP))
    lc.write_steps(log, f"{at}/files")
    lc.write_steps(lc.collate_index(log.where("step % 2 = 0"), STEP), f"{at}/index")
    lc.build_missed(s, f"{at}/files", f"{at}/index", STEP)
    if lc.build_missed(s, f"{at}/files", f"{at}/index", STEP):
        raise AssertionError("an index was built twice")
    return s.read.parquet(f"{at}/index").select(F.col("step").cast("bigint").alias("step"), "k", "n", "first_tx", "last_tx")


_MERGED = f"(SELECT DISTINCT entity AS name, start_step // 64 * 64 AS start_step, start_step // 64 * 64 + 64 AS end_step FROM {FI} WHERE start_step < 1024)"
_FILES = f"(SELECT DISTINCT entity AS name, start_step, end_step FROM {FI})"
_INSIDE = "m.name = f.name AND m.start_step <= f.start_step AND m.end_step >= f.end_step AND (m.start_step, m.end_step) <> (f.start_step, f.end_step)"


def _merge(s, d) -> tuple[DataFrame, DataFrame]:
    listed = file_ranges(s, d).select(F.col("entity").alias("name"), "start_step", "end_step")
    start = (F.floor(F.col("start_step") / 64) * 64).cast("bigint")
    return listed, listed.where("start_step < 1024").select("name", start.alias("start_step"), (start + 64).alias("end_step"))


@query("s6_integrate", f"WITH u AS (SELECT * FROM {_FILES} UNION SELECT * FROM {_MERGED}) SELECT * FROM u f WHERE NOT EXISTS (SELECT 1 FROM u m WHERE {_INSIDE})")
def _(s, d):
    return lc.integrate(*_merge(s, d))


@query("s6_garbage", f"WITH u AS (SELECT * FROM {_FILES} UNION SELECT * FROM {_MERGED}) SELECT * FROM {_FILES} f WHERE EXISTS (SELECT 1 FROM u m WHERE {_INSIDE})")
def _(s, d):
    return lc.garbage(*_merge(s, d))


@query("a2_prune_in_time", f"SELECT k, tx, v FROM {EV} WHERE tx >= {HALF}")
def _(s, d):
    """A hot log pruned by calls that may each do one batch, until all is done."""
    store, end = VersionedTable(s, fresh(s, "hot")), half(s, d)
    store.commit(events(s, d).select("k", "tx", "v"))
    at = 0
    while at < end:
        ticks = iter([0.0, 0.0, 9.0, 9.0])
        at = lc.prune_in_time(store, at, end, batch=max(1, -(-end // 3)), seconds=1.0, clock=lambda t=ticks: next(t))
    return store.view()


@query("a8_rotate_flush_discard", f"SELECT k, tx, v FROM {EV} WHERE tx % 3 <> 2")
def _(s, d):
    """Of three batches two are flushed and one is discarded."""
    wal, ev = lc.Wal(s, fresh(s, "wal")), events(s, d).select("k", "tx", "v")
    wal.write(ev.where("tx % 3 = 0"))
    wal.write(ev.where("tx % 3 = 1"))
    taken = wal.rotate()
    wal.write(ev.where("tx % 3 = 2"))
    wal.flush(taken)
    wal.discard()
    return wal.hot()


@query("d12_add_prev", f"SELECT k, tx, v, prev FROM {HI}")
def _(s, d):
    ev, at = events(s, d), half(s, d)
    return tp.add_prev(tp.history(ev.where(F.col("tx") < at)), ev.where(F.col("tx") >= at))


@query(
    "d11_write_surface",
    f"""WITH a AS (SELECT 'u' || lpad(CAST(k AS VARCHAR), 8, '0') AS k, tx, v, event_type FROM {EV}), st AS (SELECT k || '/' || event_type AS k, tx, v FROM a WHERE tx < {HALF}),
    gone AS (SELECT DISTINCT k FROM a WHERE right(k, 1) = '7'), live AS (SELECT k, arg_max_null(v, tx) AS v FROM st GROUP BY k),
    writes AS (SELECT k, tx, v FROM st UNION ALL SELECT l.k, {HALF}, NULL FROM live l WHERE v IS NOT NULL AND left(l.k, 9) IN (SELECT k FROM gone))
    SELECT 'storage' AS domain, k, tx, v FROM writes UNION ALL SELECT 'account', k, tx, v FROM a WHERE tx < {HALF} UNION ALL SELECT 'account', k, {HALF}, NULL FROM gone""",
)
def _(s, d):
    """Accounts and their storage as two domains; accounts that are deleted take their storage with them."""
    at = half(s, d)
    a = events(s, d).withColumn("k", F.concat(F.lit("u"), F.lpad(F.col("k").cast("string"), 8, "0")))
    early = a.where(F.col("tx") < at)
    w = tp.Writes({n: early.select("k", "tx", "v").limit(0) for n in ("account", "storage")}, ix.build(early, account="k").limit(0), parent="account", child="storage")
    w.update("account", early)
    w.update("storage", early.withColumn("k", F.concat("k", F.lit("/"), "event_type")))
    w.add("account", early)
    w.delete(a.where(F.endswith("k", F.lit("7"))).select("k", F.lit(at).cast("bigint").alias("tx")))
    parts = [w.domains[n].select(F.lit(n).alias("domain"), "k", "tx", "v") for n in ("account", "storage")]
    return parts[0].unionByName(parts[1])


_BL = f"(SELECT tx // 100 AS block, max(tx) AS max_tx FROM {EV} GROUP BY 1)"


@query("n4_append_truncate", f"SELECT block, max_tx FROM {_BL}")
def _(s, d):
    """Blocks cut at half and appended again."""
    b = events(s, d).groupBy(F.floor(F.col("tx") / 100).cast("bigint").alias("block")).agg(F.max("tx").alias("max_tx"))
    at = half(s, d) // 100
    return tp.append_blocks(tp.truncate_blocks(b, at), b.where(F.col("block") >= at))


@query("n4_first_last", f"SELECT min(block) AS first, arg_min(max_tx, block) AS first_tx, max(block) AS last, arg_max(max_tx, block) AS last_tx FROM {_BL}")
def _(s, d):
    return tp.first_last_block(events(s, d).groupBy(F.floor(F.col("tx") / 100).cast("bigint").alias("block")).agg(F.max("tx").alias("max_tx")))


@query("g4_domain_get_as_of", f"SELECT k, arg_max_null(v, tx) AS v FROM {EV} WHERE tx < {HALF} GROUP BY k HAVING arg_max_null(v, tx) IS NOT NULL")
def _(s, d):
    return tp.TemporalFrame(table(s, d, "events"), "user_id", "event_id", "value").domain_get_as_of(half(s, d))


@query(
    "g4_history_get",
    f"""SELECT p.k, {HALF} AS at, m.tx IS NOT NULL AS found, h.prev AS v FROM (SELECT DISTINCT k FROM {EV}) p
    LEFT JOIN (SELECT k, min(tx) AS tx FROM {HI} WHERE tx >= {HALF} GROUP BY k) m ON m.k = p.k LEFT JOIN {HI} h ON h.k = m.k AND h.tx = m.tx""",
)
def _(s, d):
    t = tp.TemporalFrame(table(s, d, "events"), "user_id", "event_id", "value")
    return t.history_get(t.log.select("k").distinct().withColumn("at", F.lit(half(s, d)).cast("bigint")))


# loading and overlays -------------------------------------------------------------------------------------------------------


@query("e10_next_key", "SELECT o_orderkey, lpad(lower(to_hex(o_orderkey * 251 + 1)), 16, '0') AS next FROM orders")
def _(s, d):
    x = F.col("o_orderkey") * 251
    return table(s, d, "orders").select("o_orderkey", F.lower(F.hex(etl.following_key(codec.u64_bytes(x)))).alias("next"))


@query("e12_resume", f"WITH n AS (SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderkey % 2, o_orderkey)) AS v FROM orders GROUP BY 1) SELECT k, v FROM n UNION ALL SELECT k, v FROM {CU} WHERE k NOT IN (SELECT k FROM n)")
def _(s, d):
    """Pairs collected in two runs; the second, after the first one died in its second batch, goes on from the files."""
    at, o = fresh(s, "collected"), table(s, d, "orders").repartition(1).sortWithinPartitions("o_orderkey").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("n"))
    etl.Collector(s, at).collect(o.where("n % 2 = 0"), 1)
    etl.Collector(s, at).collect(o.where("n % 2 = 1 and k < 9"), 2)
    again = etl.Collector(s, at)
    again.collect(o.where("n % 2 = 1"), 2)
    return again.load(customers(s, d))


@query("m6_memory_batch", f"SELECT k, v FROM (SELECT k, CASE WHEN k % 5 = 1 THEN v + 10 ELSE v END AS v FROM {CU} WHERE k % 5 <> 2 UNION ALL SELECT -k, v FROM {CU} WHERE k % 5 = 3)")
def _(s, d):
    c = customers(s, d)
    b = overlay.Batch(c, {"id": 7})
    b.put(c.where("k % 5 in (1, 2)").select("k", (F.col("v") + 10).alias("v")))
    b.delete(c.where("k % 5 = 2"))
    b.put(c.where("k % 5 = 3").select((-F.col("k")).alias("k"), "v"))
    if (b.increment("id", 3), b.increment("id", 1)) != (7, 10):
        raise AssertionError("the sequence went wrong")
    return b.read()


@query("g7_pages", "SELECT c_custkey AS k, c_name AS v FROM customer")
def _(s, d):
    """Pairs written as chains of pages to shared storage and read back through the paged source."""
    at = fresh(s, "pages")
    pages.write_pages(table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), at, 4, 100)
    pages.register(s)
    return s.read.format("pages").load(at)


# suffixes, covers, trees -----------------------------------------------------------------------------------------------------


@query(
    "z3_suffix_array",
    """WITH s AS (SELECT p_partkey, pos, substr(p_name, CAST(pos + 1 AS INT)) AS s FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name))) AS pos FROM part)),
    r AS (SELECT *, row_number() OVER o - 1 AS rank, lag(s) OVER o AS p FROM s WINDOW o AS (ORDER BY s, p_partkey, pos))
    SELECT rank, p_partkey, CAST(pos AS INT) AS pos, CASE WHEN p IS NOT NULL THEN CAST(len(list_filter(range(1, 1 + least(length(s), length(p))), lambda i: substr(s, 1, CAST(i AS INT)) = substr(p, 1, CAST(i AS INT)))) AS INT) END AS lcp FROM r""",
)
def _(s, d):
    return formats.suffix_array(table(s, d, "part"), "p_partkey", "p_name")


@query("z6_cover", "SELECT p_partkey, CAST(2 * len(string_split(p_name, ' ')) + 1 * (len(string_split(p_name, ' ')) - 1) AS INT) AS cost FROM part")
def _(s, d):
    """Names covered by the words that names are made of; their words are longer than a reference."""
    part = table(s, d, "part")
    return formats.cover(part, part.select(F.explode(F.split("p_name", " ")).alias("word")), text_id="p_partkey", text="p_name").select("p_partkey", "cost")


@query("t2_review_keys", f"SELECT t.k, l.v FROM (SELECT DISTINCT k FROM {EV} WHERE tx >= {HALF}) t LEFT JOIN (SELECT k, arg_max_null(v, tx) AS v FROM {EV} GROUP BY k) l ON l.k = t.k")
def _(s, d):
    ev = events(s, d)
    return commitment.review_keys(ev.where(F.col("tx") >= half(s, d)), tp.latest(ev))


def _entries(log: DataFrame) -> DataFrame:
    return tp.latest(log).select(F.col("k").cast("string").cast("binary").alias("k"), F.col("v").cast("string").cast("binary").alias("v"))


@query("t3_state_kept", "SELECT true AS kept, true AS updated")
def _(s, d):
    """A tree kept as of half time and then updated with the keys changed since: its roots are those of trees built anew."""
    ev, at = events(s, d), half(s, d)
    then, now = _entries(ev.where(F.col("tx") < at)), _entries(ev)
    tree = commitment.TreeState(s, fresh(s, "tree"))
    tree.save(then)
    kept = tree.root().select(F.col("root").alias("a")).scalar() == commitment.state_root(then).scalar()
    one = s.range(1).select(kept.alias("kept"))
    row = one.first()
    tree.update(now, ev.where(F.col("tx") >= at).select(F.col("k").cast("string").cast("binary").alias("k")))
    return s.range(1).select(F.lit(row["kept"]).alias("kept"), (tree.root().scalar() == commitment.state_root(now).scalar()).alias("updated"))


@query("t6_touched", f"SELECT DISTINCT k FROM {EV} WHERE tx >= 5000")
def _(s, d):
    """The keys of t6_touched_keys, whose hashed paths SQL can't state."""
    return commitment.touched_keys(events(s, d), 5000).select("k")


@query(
    "t4_binary_branches",
    """WITH k AS (SELECT DISTINCT o_custkey AS k FROM orders), p AS (SELECT k, lag(k) OVER (ORDER BY k) AS b FROM k)
    SELECT DISTINCT CAST(32 - length(ltrim(CAST(CAST(xor(k, b) AS BIT) AS VARCHAR), '0')) AS INT) AS depth, k >> CAST(length(ltrim(CAST(CAST(xor(k, b) AS BIT) AS VARCHAR), '0')) AS INT) AS prefix FROM p WHERE b IS NOT NULL""",
)
def _(s, d):
    return commitment.binary_branches(table(s, d, "orders"), "o_custkey", 32)


@query(
    "t8_tree23",
    """WITH RECURSIVE k AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS rank FROM (SELECT DISTINCT o_custkey AS k FROM orders)),
    h AS (SELECT min(i) AS h, (SELECT count(*) FROM k) AS n FROM range(1, 30) r(i) WHERE CAST(pow(3, i) AS BIGINT) - 1 >= (SELECT count(*) FROM k)),
    t(level, first, size) AS (
      SELECT h, CAST(0 AS BIGINT), n FROM h WHERE n > 0
      UNION ALL
      SELECT level - 1, first + CASE WHEN i = 0 THEN 0 WHEN i = 1 THEN a + 1 ELSE a + b + 2 END, CASE WHEN i = 0 THEN a WHEN i = 1 THEN b ELSE c END
      FROM (SELECT *, CASE WHEN p = 2 THEN (size - 1 + 1) // 2 ELSE (size - 2 + 2) // 3 END AS a, CASE WHEN p = 2 THEN (size - 1) // 2 ELSE (size - 2 + 1) // 3 END AS b, CASE WHEN p = 3 THEN (size - 2) // 3 END AS c
        FROM (SELECT *, CASE WHEN size - 1 <= 2 * (CAST(pow(3, level - 1) AS BIGINT) - 1) THEN 2 ELSE 3 END AS p FROM t WHERE level > 1)), range(0, 3) x(i) WHERE i < p
    ), o AS (
      SELECT level, first, CASE WHEN p = 2 THEN (size - 1 + 1) // 2 ELSE (size - 2 + 2) // 3 END AS a, CASE WHEN p = 3 THEN (size - 2 + 1) // 3 END AS b
      FROM (SELECT *, CASE WHEN (level > 1 AND size - 1 <= 2 * (CAST(pow(3, level - 1) AS BIGINT) - 1)) OR (level = 1 AND size = 1) THEN 2 ELSE 3 END AS p FROM t)
    )
    SELECT k, CAST(level AS INT) AS level, first AS node FROM (SELECT level, first, first + a AS rank FROM o UNION ALL SELECT level, first, first + a + b + 1 FROM o WHERE b IS NOT NULL) JOIN k USING (rank)""",
)
def _(s, d):
    return commitment.tree23(table(s, d, "orders"), "o_custkey")


# pools --------------------------------------------------------------------------------------------------------------------------

_POOLED = f"""(WITH b AS (SELECT *, min(nonce) OVER (PARTITION BY sender_id) AS base FROM {SLOT})
    SELECT sender_id, nonce, arrival_id, tip, fee_cap, nonce = base + row_number() OVER (PARTITION BY sender_id ORDER BY nonce) - 1 AS no_gap, CAST(sum(gas) OVER (PARTITION BY sender_id ORDER BY nonce ROWS UNBOUNDED PRECEDING) AS BIGINT) <= 2000000 AS covered FROM b)"""
_FEE = 20_000_000_000


def _pooled(s, d) -> DataFrame:
    one = slots(s, d).select("sender_id", "nonce", "arrival_id", "tip", "fee_cap", "gas")
    r = pool.running_conditions(one.join(one.groupBy("sender_id").agg(F.min("nonce").alias("base")), "sender_id"), owner="sender_id", number="nonce", base="base", sums={"so_far": "gas"}, mins={})
    return r.select("sender_id", "nonce", "arrival_id", "tip", "fee_cap", "no_gap", (F.col("so_far") <= 2_000_000).alias("covered"))


_CLASSIFIED = f"""(SELECT sender_id, nonce, arrival_id, pool FROM (SELECT *, CASE WHEN no_gap AND covered AND fee_cap >= {_FEE} THEN 'pending' WHEN no_gap AND covered THEN 'base_fee' ELSE 'queued' END AS pool FROM {_POOLED})
    QUALIFY row_number() OVER (PARTITION BY pool ORDER BY tip DESC, arrival_id) <= CASE pool WHEN 'pending' THEN 1000 WHEN 'base_fee' THEN 500 ELSE 2000 END)"""


def _classified(s, d) -> DataFrame:
    limits = {"pending": 1000, "base_fee": 500, "queued": 2000}
    return pool.classify(_pooled(s, d), fee="fee_cap", base_fee=_FEE, order=[F.desc("tip"), F.asc("arrival_id")], limits=limits).select("sender_id", "nonce", "arrival_id", "pool")


@query("pool11_promote", f"SELECT * FROM {_CLASSIFIED}")
def _(s, d):
    return _classified(s, d)


@query("pool22_status", f"SELECT pool, count(*) AS n FROM {_CLASSIFIED} GROUP BY pool")
def _(s, d):
    return pool.status(_classified(s, d))


@query("pool18_kept", f"SELECT sender_id, nonce, arrival_id, pool, 77 AS last_block FROM {_CLASSIFIED}")
def _(s, d):
    """A pool flushed and loaded again, with the last block it has seen."""
    store = pool.PoolStore(s, fresh(s, "pool"))
    store.flush(_classified(s, d), 77)
    kept, block = store.load()
    return kept.withColumn("last_block", F.lit(block))


@query(
    "pool1_after_block",
    """WITH p AS (SELECT sender_id, nonce, arrival_id, tip, id_hash FROM pool_txs WHERE NOT is_local AND tx_type <> 0 AND id_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sender_id, nonce ORDER BY tip DESC, arrival_id DESC) = 1),
    u AS (SELECT sender_id, nonce, arrival_id, tip, id_hash FROM pool_txs WHERE tx_type = 0 AND id_hash IS NOT NULL AND id_hash NOT IN (SELECT id_hash FROM p)),
    a AS (SELECT * FROM (SELECT * FROM p UNION ALL SELECT * FROM u) QUALIFY row_number() OVER (PARTITION BY sender_id, nonce ORDER BY tip DESC, arrival_id DESC) = 1),
    m AS (SELECT sender_id AS sid, max(nonce) AS done FROM pool_txs WHERE is_local GROUP BY 1)
    SELECT arrival_id FROM a LEFT JOIN m ON sid = sender_id WHERE done IS NULL OR nonce > done""",
)
def _(s, d):
    """Local entries stand for those mined, entries of type 0 for those that a block took back."""
    t = txs(s, d).select("sender_id", "nonce", "arrival_id", "tip", "id_hash", "is_local", "tx_type")
    slot, better = ["sender_id", "nonce"], ["tip", "arrival_id"]
    held = pool.per_slot(t.where("not is_local and tx_type <> 0 and id_hash is not null").select(*slot, *better, "id_hash"), slot, better)
    back = t.where("tx_type = 0").select(*slot, *better, "id_hash")
    return pool.after_block(held, t.where("is_local"), back, key="id_hash", owner="sender_id", number="nonce", slot=slot, better=better).select("arrival_id")


@query(
    "pool2_add",
    """WITH p AS (SELECT sender_id, nonce, tip, arrival_id, id_hash FROM pool_txs WHERE arrival_id % 2 = 0 AND id_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sender_id, nonce ORDER BY tip DESC, arrival_id DESC) = 1),
    u AS (SELECT sender_id, nonce, tip, arrival_id, id_hash FROM pool_txs WHERE arrival_id % 2 = 1 AND id_hash IS NOT NULL AND id_hash NOT IN (SELECT id_hash FROM p))
    SELECT arrival_id FROM (SELECT * FROM p UNION ALL SELECT * FROM u) QUALIFY row_number() OVER (PARTITION BY sender_id, nonce ORDER BY tip DESC, arrival_id DESC) = 1""",
)
def _(s, d):
    t = txs(s, d).select("sender_id", "nonce", "tip", "arrival_id", "id_hash")
    slot, better = ["sender_id", "nonce"], ["tip", "arrival_id"]
    held = pool.per_slot(t.where("arrival_id % 2 = 0 and id_hash is not null"), slot, better)
    return pool.add(held, t.where("arrival_id % 2 = 1"), key="id_hash", slot=slot, better=better).select("arrival_id")


@query("pool20_fetch", "SELECT arrival_id FROM pool_txs WHERE id_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sender_id, nonce ORDER BY tip DESC, arrival_id DESC) = 1")
def _(s, d):
    """Packets of transactions, an array of them a row, as a stream into a kept pool."""
    at = fresh(s, "fetch")
    one = F.struct("sender_id", "nonce", "tip", "arrival_id", "id_hash")
    packets = txs(s, d).groupBy(F.floor(F.col("arrival_id") / 64).alias("packet")).agg(F.collect_list(one).alias("txs"))
    packets.write.parquet(f"{at}/packets")
    fetch = Fetch(pool.PoolStore(s, f"{at}/pool"), key="id_hash", slot=["sender_id", "nonce"], better=["tip", "arrival_id"], read=lambda b: b.select(F.explode("txs").alias("x")).select("x.*"))
    fetch.follow(s.readStream.schema(packets.schema).parquet(f"{at}/packets"), f"{at}/checkpoint").awaitTermination()
    return fetch.store.load()[0].select("arrival_id")


# streams and files -----------------------------------------------------------------------------------------------------------------


@query("i15_expect_equal", "SELECT true AS equal, false AS after_a_change")
def _(s, d):
    a = order_pairs(s, d)
    return s.createDataFrame([(streams.same(a, a.repartition(3)), streams.same(a, a.union(a.limit(1))))], "equal boolean, after_a_change boolean")


@query("i16_pairs_with_error", f"SELECT count(*) FILTER (WHERE v < 500) AS before, true AS failed FROM {OP}")
def _(s, d):
    """A stream that fails at one entry: what lies before it can be read, reading on raises the error."""
    at = 500
    n = streams.failing(order_pairs(s, d).where("v < 500"), at, "v").agg(F.count("v")).first()[0]
    bad = streams.failing(order_pairs(s, d), at, "v")
    try:
        bad.agg(F.sum("v")).collect()
        failed = False
    except Exception as e:
        failed = "expected error at iteration" in str(e)
    return s.createDataFrame([(n, failed)], "before bigint, failed boolean")


@query("i17_order", f"SELECT * FROM (SELECT 'asc' AS way, v FROM {OP} ORDER BY v LIMIT 200) UNION ALL SELECT * FROM (SELECT 'desc', v FROM {OP} ORDER BY v DESC LIMIT 200)")
def _(s, d):
    v = order_pairs(s, d).select("v")
    return streams.union(v, v, limit=200).select(F.lit("asc").alias("way"), "v").union(streams.union(v, v, asc=False, limit=200).select(F.lit("desc").alias("way"), "v"))


@query("c4_step_files", f"SELECT tx // 1000 AS step, k, tx, v FROM {EV} WHERE tx // 1000 >= 2 AND tx // 1000 < 7")
def _(s, d):
    at = fresh(s, "steps")
    lc.write_steps(events(s, d).select("k", "tx", "v").withColumn("step", lc.step_of(STEP)), at)
    return lc.read_steps(s, at, 2, 7).select(F.col("step").cast("bigint").alias("step"), "k", "tx", "v")


@query("z1_word_file", "SELECT n, word FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS n, p_name AS word FROM part) WHERE n >= 700")
def _(s, d):
    at = fresh(s, "words")
    words = kv.sequence(table(s, d, "part").select("p_partkey", F.col("p_name").alias("word")), "p_partkey")
    formats.write_words(words.select(F.col("seq").alias("n"), "word"), at)
    return formats.read_words(s, at, 700)


@query("z10_perfect_hash", "SELECT count(DISTINCT o_orderkey) AS keys, count(DISTINCT o_orderkey) AS ordinals, CAST(0 AS BIGINT) AS first, count(DISTINCT o_orderkey) - 1 AS last FROM orders")
def _(s, d):
    """Each key has a number of its own, and the numbers have no gap."""
    keys = table(s, d, "orders").select("o_orderkey")
    o = formats.lookup(formats.perfect_hash(keys, "o_orderkey"), keys.distinct(), "o_orderkey")
    return o.agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("ordinal").alias("ordinals"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


# byte forms --------------------------------------------------------------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def _typed(nonce: pd.Series, tip: pd.Series, fee_cap: pd.Series, gas: pd.Series, value: pd.Series, creation: pd.Series) -> pd.Series:
    """Transactions of type 2 with a placeholder for their signature."""
    n = rlp.number
    rows = zip(nonce, tip, fee_cap, gas, value, creation)
    return pd.Series([b"\x02" + rlp.encode([n(1), n(int(a)), n(int(t)), n(int(f)), n(int(g)), b"" if c else b"\x05" * 20, n(int(v)), b"ab\0", [], n(0), n(1), n(1)]) for a, t, f, g, v, c in rows], dtype=object)


@query("f10_parse_transactions", "SELECT arrival_id, nonce, CAST(tip AS VARCHAR) AS tip, CAST(fee_cap AS VARCHAR) AS fee_cap, gas, CAST(tx_value AS VARCHAR) AS value, creation, 3 AS data_len, 2 AS data_nonzero_len FROM pool_txs")
def _(s, d):
    cols = ["tip", "fee_cap", "tx_value"]
    t = txs(s, d).select("arrival_id", "nonce", "gas", "creation", *[F.col(c).cast("string").alias(c) for c in cols])
    raw = t.select("arrival_id", _typed("nonce", "tip", "fee_cap", "gas", "tx_value", "creation").alias("raw"))
    x = raw.select("arrival_id", transactions.parse_column(F.col("raw"), with_sender=False).alias("x"))
    out = [F.col(f"x.{c}").cast("string").alias(c) for c in ("tip", "fee_cap", "value")]
    return x.select("arrival_id", "x.nonce", "x.gas", "x.creation", F.col("x.data_len").cast("int").alias("data_len"), F.col("x.data_nonzero_len").cast("int").alias("data_nonzero_len"), *out)


@F.pandas_udf(T.BinaryType())
def _packet(request: pd.Series, hashes: pd.Series) -> pd.Series:
    return pd.Series([transactions.hashes_packet(int(r), [bytes(h) for h in hs]) for r, hs in zip(request, hashes)], dtype=object)


@query("f11_hash_packets", "SELECT arrival_id // 50 AS request, lower(hex(id_hash)) AS item FROM pool_txs WHERE octet_length(id_hash) = 32")
def _(s, d):
    t = txs(s, d).where(F.octet_length("id_hash") == 32).groupBy(F.floor(F.col("arrival_id") / 50).alias("request")).agg(F.collect_list("id_hash").alias("hashes"))
    sent = t.select(_packet("request", "hashes").alias("p"))
    got = sent.mapInPandas(transactions.explode_packets("p", transactions.parse_hashes_packet), "request bigint, item binary")
    return got.select("request", F.lower(F.hex("item")).alias("item"))


@F.pandas_udf(T.StructType().add("nonce", T.LongType()).add("balance", T.StringType()))
def _sender_round(nonce: pd.Series, balance: pd.Series) -> pd.DataFrame:
    back = [accounts.decode_sender(accounts.encode_sender(int(n), int(b))) for n, b in zip(nonce, balance)]
    return pd.DataFrame({"nonce": [x[0] for x in back], "balance": [str(x[1]) for x in back]})


@query("f12_senders", "SELECT row_id, nonce, CAST(balance AS VARCHAR) AS balance FROM account_snapshots WHERE balance IS NOT NULL")
def _(s, d):
    a = table(s, d, "account_snapshots").where("balance is not null")
    return a.select("row_id", _sender_round("nonce", F.col("balance").cast("string")).alias("x")).select("row_id", "x.*")


@query("f14_lists", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS a, CAST(o_orderkey * 3 AS VARCHAR) AS b FROM orders")
def _(s, d):
    little = lambda x: F.unhex(F.array_join(F.reverse(F.array(*[F.substring(F.hex(codec.u64_bytes(x)), 2 * i + 1, F.lit(2)) for i in range(8)])), ""))
    o = table(s, d, "orders").select("o_orderkey", F.concat(little(F.col("o_custkey")), little(F.col("o_orderkey") * 3)).alias("data"))
    return o.select("o_orderkey", lists.numbers(F.col("data"), 4).alias("x")).select("o_orderkey", F.get("x", F.lit(0)).cast("string").alias("a"), F.get("x", F.lit(1)).cast("string").alias("b"))
