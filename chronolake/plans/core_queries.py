"""Queries over key-value tables, streams, indexes and the temporal core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.operators import index as ix
from chronolake.operators import kv, streams
from chronolake.operators import temporal as tp
from chronolake.plans.registry import core
from chronolake.session import table

query = core.query


def events(s: SparkSession, d: str) -> DataFrame:
    """The change log of users: key, time, value."""
    return table(s, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("tx"), F.col("value").alias("v"), "event_type")


def customers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))


def order_pairs(s: SparkSession, d: str) -> DataFrame:
    """A table with several values a key: orders of a customer."""
    return table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))


EV = "(SELECT user_id AS k, event_id AS tx, value AS v, event_type FROM events)"
CU = "(SELECT c_custkey AS k, c_acctbal AS v FROM customer)"
OP = "(SELECT o_custkey AS k, o_orderkey AS v FROM orders)"
HI = f"(SELECT k, tx, v, lag(v) OVER (PARTITION BY k ORDER BY tx) AS prev FROM {EV})"


# point access ---------------------------------------------------------------------------------------------------------


@query("k1_get_one", f"SELECT k, v FROM {CU} WHERE k IN (SELECT o_custkey FROM orders)")
def _(s, d):
    return kv.get(customers(s, d), order_pairs(s, d))


@query("k2_has", f"SELECT DISTINCT s_suppkey * 3 AS k, (s_suppkey * 3) IN (SELECT o_custkey FROM orders) AS found FROM supplier")
def _(s, d):
    return kv.has(order_pairs(s, d), table(s, d, "supplier").select((F.col("s_suppkey") * 3).alias("k")))


@query(
    "k3_first_last",
    f"""SELECT * FROM (SELECT 'first' AS which, k, v FROM {OP} WHERE k IS NOT NULL ORDER BY k, v LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'last' AS which, k, v FROM {OP} WHERE k IS NOT NULL ORDER BY k DESC, v DESC LIMIT 1)""",
)
def _(s, d):
    return kv.first_and_last(order_pairs(s, d))


@query("k4_seek", f"SELECT p.probe, min(o.k) AS k FROM (SELECT DISTINCT p_partkey AS probe FROM part) p JOIN (SELECT DISTINCT k FROM {OP}) o ON o.k >= p.probe GROUP BY p.probe")
def _(s, d):
    return kv.seek(order_pairs(s, d), table(s, d, "part").select(F.col("p_partkey").alias("probe")))


@query("k5_seek_exact", f"SELECT k, v FROM {OP} WHERE k IN (SELECT s_suppkey FROM supplier)")
def _(s, d):
    return kv.get(order_pairs(s, d), table(s, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query(
    "k6_next_prev",
    f"""SELECT k, v, lead(k) OVER o AS next_k, lead(v) OVER o AS next_v, lag(k) OVER o AS prev_k, lag(v) OVER o AS prev_v
    FROM {OP} WINDOW o AS (ORDER BY k, v)""",
)
def _(s, d):
    return kv.cursor(order_pairs(s, d))


@query("k7_count", f"SELECT count(*) AS n FROM {OP}")
def _(s, d):
    return order_pairs(s, d).agg(F.count(F.lit(1)).alias("n"))


@query(
    "k8_seek_both_exact",
    f"""SELECT DISTINCT l_suppkey AS k, l_orderkey AS v FROM lineitem WHERE (l_suppkey, l_orderkey) IN (SELECT k, v FROM {OP})""",
)
def _(s, d):
    return kv.seek_both_exact(order_pairs(s, d), table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("v")))


@query(
    "k9_seek_both_range",
    f"""SELECT p.k, p.probe, min(o.v) AS v FROM (SELECT DISTINCT l_suppkey AS k, l_orderkey AS probe FROM lineitem) p
    JOIN {OP} o ON o.k = p.k AND o.v >= p.probe GROUP BY p.k, p.probe""",
)
def _(s, d):
    return kv.seek_both_range(order_pairs(s, d), table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("probe")))


@query("k10_first_last_dup", f"SELECT k, min(v) AS first_v, max(v) AS last_v FROM {OP} GROUP BY k")
def _(s, d):
    return kv.dup_summary(order_pairs(s, d)).select("k", "first_v", "last_v")


@query("k11_next_prev_dup", f"SELECT k, v, lag(v) OVER o AS prev_v, lead(v) OVER o AS next_v FROM {OP} WINDOW o AS (PARTITION BY k ORDER BY v)")
def _(s, d):
    return kv.dup_cursor(order_pairs(s, d))


@query("k12_next_no_dup", f"SELECT k, min(v) AS v FROM {OP} GROUP BY k")
def _(s, d):
    return kv.dup_summary(order_pairs(s, d)).select("k", F.col("first_v").alias("v"))


@query("k13_count_duplicates", f"SELECT k, count(DISTINCT v) AS n FROM {OP} GROUP BY k")
def _(s, d):
    return kv.dup_summary(order_pairs(s, d)).select("k", "n")


@query("k14_first_last_key", f"SELECT min(k) AS first_k, max(k) AS last_k FROM {OP}")
def _(s, d):
    return order_pairs(s, d).agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"))


@query("k15_table_size", f"SELECT count(*) AS n, CAST(coalesce(sum(strlen(CAST(k AS VARCHAR)) + coalesce(strlen(CAST(v AS VARCHAR)), 0)), 0) AS BIGINT) AS bytes FROM {OP}")
def _(s, d):
    return kv.table_size(order_pairs(s, d))


@query("k16_sequence", "SELECT o_orderkey AS v, row_number() OVER (ORDER BY o_orderkey) - 1 + 1000 AS seq FROM orders")
def _(s, d):
    return kv.sequence(table(s, d, "orders").select(F.col("o_orderkey").alias("v")), "v", 1000)


@query("k17_config_flag", "SELECT count(DISTINCT aggregation_step) = 1 AS unchanged, min(aggregation_step) AS flag FROM ingest_runs")
def _(s, d):
    return table(s, d, "ingest_runs").agg((F.count_distinct("aggregation_step") == 1).alias("unchanged"), F.min("aggregation_step").alias("flag"))


# ranges ----------------------------------------------------------------------------------------------------------------


@query("r1_range", f"SELECT k, v FROM {OP} WHERE k >= 100 AND k < 700")
def _(s, d):
    return kv.key_range(order_pairs(s, d), 100, 700)


@query("r2_range_ascend_limit", f"SELECT k, v FROM {OP} WHERE k >= 100 AND k < 700 ORDER BY k, v LIMIT 25")
def _(s, d):
    return kv.key_range(order_pairs(s, d), 100, 700, limit=25)


@query("r3_range_descend_limit", f"SELECT k, v FROM {OP} WHERE k <= 700 AND k > 100 ORDER BY k DESC, v DESC LIMIT 25")
def _(s, d):
    return kv.key_range(order_pairs(s, d), 700, 100, asc=False, limit=25)


@query("r4_prefix", "SELECT p_name AS k, p_partkey AS v FROM part WHERE starts_with(p_name, 's')")
def _(s, d):
    return kv.prefix_scan(table(s, d, "part").select(F.col("p_name").alias("k"), F.col("p_partkey").alias("v")), "s")


@query("r5_dup_range", f"SELECT k, v FROM {OP} WHERE k = 7 AND v >= 100 AND v < 14000 ORDER BY v DESC LIMIT 5")
def _(s, d):
    return kv.dup_range(order_pairs(s, d), 7, 13999, 99, asc=False, limit=5)


@query("r6_for_each", f"SELECT k, count(*) AS n FROM {OP} WHERE k >= 500 GROUP BY k")
def _(s, d):
    return kv.key_range(order_pairs(s, d), 500).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("r7_for_prefix", "SELECT address AS k, count(*) AS n FROM account_snapshots WHERE starts_with(address, '0x00') GROUP BY address")
def _(s, d):
    return kv.prefix_scan(table(s, d, "account_snapshots").select(F.col("address").alias("k")), "0x00").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("r8_for_amount", f"SELECT k, v FROM {OP} WHERE k >= 500 ORDER BY k, v LIMIT 100")
def _(s, d):
    return kv.key_range(order_pairs(s, d), 500, limit=100)


@query("r9_masked_prefix", "SELECT arrival_id AS v FROM pool_txs WHERE octet_length(id_hash) >= 2 AND left(hex(id_hash), 2) = '5A' AND substr(hex(id_hash), 3, 1) IN ('C', 'D', 'E', 'F')")
def _(s, d):
    pairs = table(s, d, "pool_txs").select(F.col("id_hash").alias("k"), F.col("arrival_id").alias("v"))
    return kv.masked_prefix(pairs, bytes([0x5A, 0xC0]), 10).select("v")


LAST = "(SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY o_custkey)"


def _updates(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))


@query("w1_put", f"SELECT k, v FROM {LAST} UNION ALL SELECT k, v FROM {CU} WHERE k NOT IN (SELECT k FROM {LAST})")
def _(s, d):
    return kv.put(customers(s, d), _updates(s, d), "seq")


@query("w2_put_if_absent", f"SELECT k, v FROM {LAST} UNION ALL SELECT k, v FROM {CU} WHERE k NOT IN (SELECT k FROM {LAST})")
def _(s, d):
    return kv.put_if_absent(kv.put(customers(s, d).limit(0), _updates(s, d), "seq"), customers(s, d))


@query("w3_append", f"SELECT k, v FROM {CU} UNION ALL SELECT s_suppkey + 1000000000, s_acctbal FROM supplier")
def _(s, d):
    return kv.appended_in_order(customers(s, d), table(s, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("k"), F.col("s_acctbal").alias("v")))


@query("w4_delete", f"SELECT k, v FROM {CU} WHERE k NOT IN (SELECT s_suppkey FROM supplier)")
def _(s, d):
    return kv.delete(customers(s, d), table(s, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("w4_delete_exact", f"SELECT k, v FROM {OP} EXCEPT SELECT l_suppkey, l_orderkey FROM lineitem")
def _(s, d):
    return kv.delete(order_pairs(s, d), table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("v")), exact=True)


# streams ---------------------------------------------------------------------------------------------------------------


def txs(s, d, kind: str) -> DataFrame:
    return events(s, d).where(F.col("event_type") == kind).select(F.col("tx").alias("v"))


def users(s, d, kind: str) -> DataFrame:
    return events(s, d).where(F.col("event_type") == kind).select(F.col("k").alias("v"))


@query("i1_literal", "SELECT * FROM (VALUES (0, 7::BIGINT), (1, 3::BIGINT), (2, 1::BIGINT)) t(pos, v)")
def _(s, d):
    return streams.literal(s, [1, 3, 7], reverse=True)


@query("i2_numbers", "SELECT CAST(range AS BIGINT) AS v FROM range(1, 1000) UNION ALL SELECT 5000::BIGINT")
def _(s, d):
    return streams.numbers(s, 1, 1000).union(streams.numbers(s, 5000, 5000))


@query("i3_empty", "SELECT event_id AS v FROM events WHERE false")
def _(s, d):
    return txs(s, d, "click").limit(0)


@query("i4_union_pairs", f"SELECT k, v FROM {CU} UNION ALL SELECT s_suppkey * 7, s_acctbal FROM supplier WHERE s_suppkey * 7 NOT IN (SELECT k FROM {CU})")
def _(s, d):
    return streams.union_pairs(customers(s, d), table(s, d, "supplier").select((F.col("s_suppkey") * 7).alias("k"), F.col("s_acctbal").alias("v")))


@query("i5_union", "SELECT DISTINCT event_id AS v FROM events WHERE event_type IN ('click', 'purchase')")
def _(s, d):
    return streams.union(txs(s, d, "click"), txs(s, d, "purchase"))


@query("i5_union_desc_limit", "SELECT DISTINCT event_id AS v FROM events WHERE event_type IN ('click', 'purchase') ORDER BY v DESC LIMIT 50")
def _(s, d):
    return streams.union(txs(s, d, "click"), txs(s, d, "purchase"), asc=False, limit=50)


@query("i6_intersect", "SELECT user_id AS v FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def _(s, d):
    return streams.intersect(users(s, d, "click"), users(s, d, "purchase"))


@query("i6_intersect_limit", "SELECT user_id AS v FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' ORDER BY v LIMIT 10")
def _(s, d):
    return streams.intersect(users(s, d, "click"), users(s, d, "purchase"), 10)


@query("i7_transform", f"SELECT k, v * 2 AS v FROM {CU}")
def _(s, d):
    return streams.transform(customers(s, d), v=F.col("v") * 2)


@query("i8_pair_to_number", "SELECT arrival_id, CAST(('0x' || right(hex(id_hash), 8)) AS BIGINT) AS v FROM pool_txs WHERE id_hash IS NOT NULL")
def _(s, d):
    return table(s, d, "pool_txs").where("id_hash is not null").select("arrival_id", F.conv(F.right(F.hex("id_hash"), F.lit(8)), 16, 10).cast("bigint").alias("v"))


@query("i9_filter_pairs", f"SELECT k, v FROM {CU} WHERE v > 1000 AND v < 5000")
def _(s, d):
    return customers(s, d).where("v > 1000 and v < 5000")


@query("i10_filter", "SELECT event_id AS v FROM events WHERE event_type = 'click' AND value > 10")
def _(s, d):
    return events(s, d).where("event_type = 'click' and v > 10").select(F.col("tx").alias("v"))


@query("i11_page", f"SELECT v, k FROM {OP} WHERE v > 500 ORDER BY v LIMIT 200")
def _(s, d):
    return streams.page(order_pairs(s, d), "v", 500, 200).select("v", "k")


@query("i12_page_pairs", f"SELECT k, v FROM {CU} WHERE k > 40 ORDER BY k LIMIT 300")
def _(s, d):
    return streams.page(customers(s, d), "k", 40, 300)


@query("i13_to_array", f"SELECT k, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS vs FROM (SELECT DISTINCT k, v FROM {OP}) GROUP BY k")
def _(s, d):
    shards = ix.to_shards(order_pairs(s, d).withColumnRenamed("v", "tx"), 2**62)
    return shards.select("k", F.array_join(F.col("ids").cast("array<string>"), ",").alias("vs"))


@query("i14_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(s, d):
    return events(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("i18_bitmap_round_trip", f"SELECT DISTINCT k, v AS tx FROM {OP}")
def _(s, d):
    return ix.from_shards(ix.to_shards(order_pairs(s, d).withColumnRenamed("v", "tx")))


# inverted indexes ------------------------------------------------------------------------------------------------------


def index(s, d) -> DataFrame:
    return ix.build(events(s, d), type="event_type", user="k")


IDX = f"(SELECT DISTINCT * FROM (SELECT 'type' AS name, event_type AS k, tx FROM {EV} UNION ALL SELECT 'user', CAST(k AS VARCHAR), tx FROM {EV}) WHERE k IS NOT NULL)"


@query("x1_add", f"SELECT name, k, tx FROM {IDX}")
def _(s, d):
    return index(s, d)


@query("x2_idx_range", f"SELECT tx FROM {IDX} WHERE name = 'type' AND k = 'click' AND tx >= 1000 AND tx < 8000")
def _(s, d):
    return ix.index_range(index(s, d), "type", "click", 1000, 8000)


@query("x2_idx_range_desc", f"SELECT tx FROM {IDX} WHERE name = 'type' AND k = 'click' AND tx <= 8000 AND tx > 1000 ORDER BY tx DESC LIMIT 40")
def _(s, d):
    return ix.index_range(index(s, d), "type", "click", 8000, 1000, asc=False, limit=40)


@query("x3_x4_two_tiers", f"SELECT tx FROM {IDX} WHERE name = 'user' AND k = '7'")
def _(s, d):
    i = index(s, d)
    frozen, recent = i.where("tx < 5000"), i.where("tx >= 5000")
    return ix.any_of(ix.index_range(frozen, "user", "7"), ix.index_range(recent, "user", "7"))


@query("x5_changed_keys", f"SELECT DISTINCT k FROM {EV} WHERE tx >= 1000 AND tx < 1100")
def _(s, d):
    return ix.changed_keys(events(s, d), 1000, 1100)


@query("x6_x7_by_name", f"SELECT name, k, count(*) AS n, min(tx) AS first_tx, max(tx) AS last_tx FROM {IDX} GROUP BY name, k")
def _(s, d):
    return index(s, d).groupBy("name", "k").agg(F.count(F.lit(1)).alias("n"), F.min("tx").alias("first_tx"), F.max("tx").alias("last_tx"))


@query("x9_merge_lists", f"SELECT k, count(DISTINCT v) AS n, min(v) AS first_v, max(v) AS last_v FROM {OP} GROUP BY k")
def _(s, d):
    p = order_pairs(s, d).withColumnRenamed("v", "tx")
    lists = ix.to_shards(p.where("tx < 8192"), 8192).union(ix.to_shards(p.where("tx >= 8192"), 8192))
    merged = lists.select("k", F.size("ids").alias("n"), F.array_min("ids").alias("a"), F.array_max("ids").alias("z"))
    return merged.groupBy("k").agg(F.sum("n").alias("n"), F.min("a").alias("first_v"), F.max("z").alias("last_v"))


@query("x10_locality", f"SELECT DISTINCT k, CAST(floor(tx / 1000.0) AS BIGINT) AS file FROM {EV}")
def _(s, d):
    return ix.locality(events(s, d), 1000)


@query(
    "x10_first_two_files",
    f"""SELECT k, min(CASE WHEN r = 1 THEN file END) AS first, min(CASE WHEN r = 2 THEN file END) AS second FROM (
      SELECT k, file, row_number() OVER (PARTITION BY k ORDER BY file) AS r FROM (SELECT DISTINCT k, CAST(floor(tx / 1000.0) AS BIGINT) AS file FROM {EV}) WHERE file >= 3
    ) GROUP BY k""",
)
def _(s, d):
    return ix.first_two_from(ix.locality(events(s, d), 1000), 3)


@query("x11_and", f"SELECT tx FROM {IDX} WHERE name = 'user' AND k = '7' INTERSECT SELECT tx FROM {IDX} WHERE name = 'type' AND k = 'click'")
def _(s, d):
    i = index(s, d)
    return ix.all_of(ix.index_range(i, "user", "7"), ix.index_range(i, "type", "click"))


@query("x11_or", f"SELECT tx FROM {IDX} WHERE (name = 'user' AND k = '7') OR (name = 'type' AND k = 'click') GROUP BY tx")
def _(s, d):
    i = index(s, d)
    return ix.any_of(ix.index_range(i, "user", "7"), ix.index_range(i, "type", "click"))


@query("b1_get", f"SELECT DISTINCT k, tx FROM {EV} WHERE tx >= 1500 AND tx < 9100")
def _(s, d):
    return ix.from_shards(ix.clipped(ix.to_shards(events(s, d)), 1500, 9100))


@query("b2_seek_in_bitmap", f"SELECT k, min(tx) FILTER (WHERE tx >= 5000) AS at FROM {EV} GROUP BY k")
def _(s, d):
    sh = ix.to_shards(events(s, d)).select("k", ix.seek_in(F.col("ids"), F.lit(5000)).alias("x"))
    return sh.groupBy("k").agg(F.min("x").alias("at"))


@query("b3_cut_left", f"SELECT k, CAST(floor(tx / 4096.0) AS BIGINT) AS shard, CAST(floor((row_number() OVER (PARTITION BY k, floor(tx / 4096.0) ORDER BY tx) - 1) / 10.0) AS INT) AS chunk, tx FROM (SELECT DISTINCT k, tx FROM {EV})")
def _(s, d):
    return ix.chunk_by_size(ix.to_shards(events(s, d)), 10).select("k", "shard", "chunk", F.explode("ids").alias("tx"))


@query("b4_chunk_keys", f"SELECT k, CAST(floor(tx / 4096.0) AS BIGINT) AS shard, max(tx) AS last_tx, count(DISTINCT tx) AS n FROM {EV} GROUP BY ALL")
def _(s, d):
    return ix.to_shards(events(s, d)).select("k", "shard", F.array_max("ids").alias("last_tx"), F.size("ids").cast("bigint").alias("n"))


@query("b5_truncate_range", f"SELECT DISTINCT k, tx FROM {EV} WHERE tx < 6000")
def _(s, d):
    return ix.from_shards(ix.clipped(ix.to_shards(events(s, d)), 0, 6000))


@query(
    "b6_b7_fixed_bitmaps",
    f"""SELECT k, min(CASE WHEN r = 1 THEN t END) AS first, min(CASE WHEN r = 2 THEN t END) AS second FROM (
      SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) AS r FROM (SELECT DISTINCT o_custkey AS k, CAST(floor(o_orderkey / 1000.0) AS BIGINT) AS t FROM orders)
    ) GROUP BY k""",
)
def _(s, d):
    return ix.first_two_from(ix.locality(order_pairs(s, d).withColumnRenamed("v", "tx"), 1000), 0)


# temporal core ---------------------------------------------------------------------------------------------------------

AT = 5000


@query("h0_add_prev", f"SELECT k, tx, v, prev FROM {HI}")
def _(s, d):
    return tp.history(events(s, d))


@query(
    "h1_get_no_state",
    f"""SELECT p.k, p.at, count(h.tx) > 0 AS found, arg_min_null(h.prev, h.tx) AS v FROM (SELECT DISTINCT user_id AS k, CAST(event_id + 37 AS BIGINT) AS at FROM events WHERE event_type = 'purchase') p
    LEFT JOIN {HI} h ON h.k = p.k AND h.tx >= p.at GROUP BY p.k, p.at""",
)
def _(s, d):
    e = events(s, d)
    return tp.get_no_state(tp.history(e), e.where("event_type = 'purchase'").select("k", (F.col("tx") + 37).alias("at")))


@query("h2_hot_and_cold", f"SELECT k, arg_min_null(prev, tx) AS v FROM {HI} WHERE tx >= {AT} GROUP BY k")
def _(s, d):
    h = tp.history(events(s, d))
    hot, cold = h.where("tx >= 9000"), h.where("tx < 9000")
    return tp.history_range(hot.union(cold), AT)


@query("h3_walk_as_of", f"SELECT k, arg_min_null(prev, tx) AS v FROM {HI} WHERE tx >= {AT} AND k >= 10 AND k < 120 GROUP BY k ORDER BY k LIMIT 60")
def _(s, d):
    return tp.walk_as_of(tp.history(events(s, d)), AT, 10, 120, 60)


@query("h4_history_range", f"SELECT k, arg_min_null(prev, tx) AS v FROM {HI} WHERE tx >= 1000 AND tx < 1400 GROUP BY k")
def _(s, d):
    return tp.history_range(tp.history(events(s, d)), 1000, 1400)


@query("h4_history_range_limit", f"SELECT k, arg_min_null(prev, tx) AS v FROM {HI} WHERE tx >= 1000 GROUP BY k ORDER BY k LIMIT 20")
def _(s, d):
    return tp.history_range(tp.history(events(s, d)), 1000, None, 20)


@query("h5_history_index", f"SELECT k, tx FROM {EV} WHERE tx >= 1000 AND tx < 9000 AND k IN (SELECT s_suppkey FROM supplier)")
def _(s, d):
    return tp.history_index(events(s, d), table(s, d, "supplier").select(F.col("s_suppkey").alias("k")), 1000, 9000)


@query("h6_history_step", f"SELECT CAST(floor(tx / 1000.0) AS BIGINT) AS step, k, count(*) AS n, max(tx) AS max_tx, arg_min_null(prev, tx) AS before FROM {HI} GROUP BY ALL")
def _(s, d):
    return tp.by_step(tp.history(events(s, d)), 1000)


@query("h7_find_by_block", f"SELECT k, arg_min_null(prev, tx) AS v FROM {HI} WHERE floor(tx / 100.0) >= 40 GROUP BY k")
def _(s, d):
    return tp.history_range(tp.history(events(s, d)), 40 * 100)


@query("h8_change_sets", f"SELECT CAST(floor(tx / 100.0) AS BIGINT) AS block, k, arg_min_null(prev, tx) AS prev FROM {HI} GROUP BY ALL")
def _(s, d):
    return tp.by_step(tp.history(events(s, d)), 100).select(F.col("step").alias("block"), "k", F.col("before").alias("prev"))


@query("h9_encode_change_sets", f"SELECT lpad(lower(to_hex(tx)), 16, '0') AS at, lpad(lower(to_hex(k)), 16, '0') AS k, prev FROM {HI}")
def _(s, d):
    from chronolake.functions.codec import u64_hex

    return tp.history(events(s, d)).select(u64_hex(F.col("tx")).alias("at"), u64_hex(F.col("k")).alias("k"), "prev")


@query("h10_available_from", f"SELECT coalesce(min(tx), 9223372036854775807) AS first_tx FROM {EV}")
def _(s, d):
    return tp.available_from(events(s, d))


@query("h11_truncate", f"SELECT k, tx, v FROM {EV} WHERE tx < {AT}")
def _(s, d):
    return tp.truncate(events(s, d), AT).select("k", "tx", "v")


@query("h12_changed_keys", f"SELECT DISTINCT k FROM {EV} WHERE tx >= 200 AND tx < 300")
def _(s, d):
    return ix.changed_keys(events(s, d), 200, 300)


@query("d1_get_latest", f"SELECT k, arg_max_null(v, tx) AS v FROM {EV} GROUP BY k HAVING arg_max_null(v, tx) IS NOT NULL")
def _(s, d):
    return tp.latest(events(s, d))


@query("d2_get_as_of", f"SELECT k, arg_max_null(v, tx) AS v FROM {EV} WHERE tx < {AT} GROUP BY k")
def _(s, d):
    return tp.as_of(events(s, d), AT)


@query("d2_get_as_of_by_history", f"SELECT k, arg_max_null(v, tx) AS v FROM {EV} WHERE tx < {AT} GROUP BY k")
def _(s, d):
    return tp.as_of_by_history(tp.history(events(s, d)), AT)


@query("d3_iterate_prefix", "SELECT address AS k, CAST(arg_max_null(nonce, row_id) AS BIGINT) AS v FROM account_snapshots WHERE starts_with(address, '0x00') GROUP BY address")
def _(s, d):
    log = table(s, d, "account_snapshots").select(F.col("address").alias("k"), F.col("row_id").alias("tx"), F.col("nonce").alias("v"))
    return tp.latest(kv.prefix_scan(log, "0x00"))


D4 = "(SELECT o_custkey AS k, o_orderkey AS tx, o_orderstatus AS v, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders)"


@query("d4_put_if_changed", f"SELECT k, tx, v, prev FROM {D4} WHERE v IS DISTINCT FROM prev")
def _(s, d):
    return tp.changes_only(table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("tx"), F.col("o_orderstatus").alias("v")))


D5 = "(SELECT k, tx, v, lag(v) OVER (PARTITION BY k ORDER BY tx) AS prev FROM (SELECT o_custkey AS k, o_orderkey AS tx, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders))"


@query("d5_delete", f"SELECT k, tx, v, prev FROM {D5} WHERE v IS DISTINCT FROM prev")
def _(s, d):
    log = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("tx"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))
    return tp.changes_only(log)


@query("d6_domain_range", f"SELECT k, arg_max_null(v, tx) AS v FROM {EV} WHERE tx < {AT} AND k >= 20 AND k < 90 GROUP BY k")
def _(s, d):
    return tp.TemporalFrame(table(s, d, "events"), "user_id", "event_id", "value").domain_range(AT, 20, 90)


@query("d7_d8_typed_readers", f"SELECT user_id AS k, arg_max_null(props, event_id) AS v, CAST(strlen(arg_max_null(props, event_id)) AS INT) AS size FROM events WHERE event_id < {AT} GROUP BY user_id")
def _(s, d):
    log = table(s, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("tx"), F.col("props").alias("v"))
    return tp.as_of(log, AT).withColumn("size", F.octet_length("v"))


@query("d9_ranges_by_domain", f"SELECT event_type, k, arg_min_null(prev, tx) AS v FROM (SELECT event_type, k, tx, lag(v) OVER (PARTITION BY event_type, k ORDER BY tx) AS prev FROM {EV}) WHERE tx >= 2000 AND tx < 4000 GROUP BY ALL")
def _(s, d):
    log = events(s, d).select(F.struct("event_type", "k").alias("k"), "tx", "v")
    return tp.history_range(tp.history(log), 2000, 4000).select("k.event_type", "k.k", "v")


@query("d10_step_surface", f"SELECT CAST(floor(tx / 1000.0) AS BIGINT) AS step, max(tx) AS max_tx, min(tx) AS min_tx, count(DISTINCT k) AS keys FROM {EV} GROUP BY 1")
def _(s, d):
    return tp.by_step(tp.history(events(s, d)), 1000).groupBy("step").agg(F.max("max_tx").alias("max_tx"), F.count(F.lit(1)).alias("keys")).join(
        events(s, d).groupBy(F.floor(F.col("tx") / 1000).cast("bigint").alias("step")).agg(F.min("tx").alias("min_tx")), "step"
    )


@query(
    "d11_delete_cascade",
    """SELECT address AS k, CAST(1000000000 AS BIGINT) AS tx, CAST(NULL AS BIGINT) AS v FROM account_snapshots WHERE starts_with(address, '0x00') GROUP BY address HAVING arg_max_null(nonce, row_id) IS NOT NULL""",
)
def _(s, d):
    log = table(s, d, "account_snapshots").select(F.col("address").alias("k"), F.col("row_id").alias("tx"), F.col("nonce").alias("v"))
    return tp.delete_prefix(log, 1_000_000_000, "0x00")


BL = "(SELECT CAST(floor(event_id / 100.0) AS BIGINT) AS block, max(event_id) AS max_tx FROM events GROUP BY 1)"


def blocks(s, d) -> DataFrame:
    return events(s, d).groupBy(F.floor(F.col("tx") / 100).cast("bigint").alias("block")).agg(F.max("tx").alias("max_tx"))


@query("n1_max_of_block", f"SELECT b.block, coalesce(x.max_tx, (SELECT max(max_tx) FROM {BL})) AS max_tx FROM (SELECT DISTINCT s_suppkey AS block FROM supplier) b LEFT JOIN {BL} x USING (block)")
def _(s, d):
    b = blocks(s, d)
    asked = table(s, d, "supplier").select(F.col("s_suppkey").alias("block")).distinct()
    return asked.join(b, "block", "left").select("block", F.coalesce(F.col("max_tx"), b.agg(F.max("max_tx")).scalar()).alias("max_tx"))


@query("n2_min_of_block", f"SELECT block, coalesce(lag(max_tx) OVER (ORDER BY block) + 1, 0) AS min_tx, max_tx FROM {BL}")
def _(s, d):
    return tp.block_bounds(blocks(s, d))


@query("n3_find_block", f"SELECT e.tx, min(b.block) AS block FROM (SELECT DISTINCT o_orderkey AS tx FROM orders) e JOIN {BL} b ON b.max_tx >= e.tx GROUP BY e.tx")
def _(s, d):
    return tp.block_of(table(s, d, "orders").select(F.col("o_orderkey").alias("tx")), blocks(s, d))


@query("n4_block_gaps", "SELECT block, before FROM (SELECT block, lag(block) OVER (ORDER BY block) AS before FROM (SELECT DISTINCT start_tx_num AS block FROM files_item WHERE start_tx_num IS NOT NULL)) WHERE block <> before + 1")
def _(s, d):
    return tp.block_gaps(table(s, d, "files_item").where("start_tx_num is not null").select(F.col("start_tx_num").alias("block")).distinct())


# times taken from the data: the queries above have fixed times, which are a smaller and smaller part of larger tables ----


def part_of_times(s, d, quarters: int):
    """So many quarters of the way through the times of the events, as a scalar subquery."""
    return events(s, d).agg(F.floor((F.max("tx") + 1) * quarters / 4).cast("bigint").alias("at")).scalar()


AT_1, AT_2, AT_3 = (f"(SELECT (max(event_id) + 1) * {q} // 4 FROM events)" for q in (1, 2, 3))


@query("d2_get_as_of_half", f"SELECT k, arg_max_null(v, tx) AS v FROM {EV} WHERE tx < {AT_2} GROUP BY k")
def _(s, d):
    return tp.as_of(events(s, d), part_of_times(s, d, 2))


@query("d6_domain_range_half", f"SELECT k, arg_max_null(v, tx) AS v FROM {EV} WHERE tx < {AT_2} AND k >= 20 AND k < 90 GROUP BY k")
def _(s, d):
    return tp.TemporalFrame(table(s, d, "events"), "user_id", "event_id", "value").domain_range(part_of_times(s, d, 2), 20, 90)


@query("d7_d8_typed_readers_half", f"SELECT user_id AS k, arg_max_null(props, event_id) AS v, CAST(strlen(arg_max_null(props, event_id)) AS INT) AS size FROM events WHERE event_id < {AT_2} GROUP BY user_id")
def _(s, d):
    log = table(s, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("tx"), F.col("props").alias("v"))
    return tp.as_of(log, part_of_times(s, d, 2)).withColumn("size", F.octet_length("v"))


@query("h4_history_range_half", f"SELECT k, arg_min_null(prev, tx) AS v FROM {HI} WHERE tx >= {AT_1} AND tx < {AT_3} GROUP BY k")
def _(s, d):
    return tp.history_range(tp.history(events(s, d)), part_of_times(s, d, 1), part_of_times(s, d, 3))


@query("h12_changed_keys_half", f"SELECT DISTINCT k FROM {EV} WHERE tx >= {AT_1} AND tx < {AT_3}")
def _(s, d):
    return ix.changed_keys(events(s, d), part_of_times(s, d, 1), part_of_times(s, d, 3))


@query("d9_ranges_by_domain_half", f"SELECT event_type, k, arg_min_null(prev, tx) AS v FROM (SELECT event_type, k, tx, lag(v) OVER (PARTITION BY event_type, k ORDER BY tx) AS prev FROM {EV}) WHERE tx >= {AT_1} AND tx < {AT_3} GROUP BY ALL")
def _(s, d):
    log = events(s, d).select(F.struct("event_type", "k").alias("k"), "tx", "v")
    return tp.history_range(tp.history(log), part_of_times(s, d, 1), part_of_times(s, d, 3)).select("k.event_type", "k.k", "v")
