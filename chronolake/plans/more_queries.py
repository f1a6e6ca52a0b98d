"""Queries over step files, loading, overlays, caches, word files, pools, codecs and hash trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.functions import codec
from chronolake.operators import commitment, etl, formats, kv, overlay, pool, streams
from chronolake.operators import lifecycle as lc
from chronolake.operators.asof import as_known_at
from chronolake.operators.ordered import neighbour, running
from chronolake.plans.core_queries import AT_2, CU, EV, LAST, OP, _updates, customers, events, index, order_pairs, part_of_times
from chronolake.plans.registry import core
from chronolake.session import table
from chronolake.sources import files

query = core.query
STEP = 1000

# step files --------------------------------------------------------------------------------------------------------------

CO = f"(SELECT CAST(floor(tx / 1000.0) AS BIGINT) AS step, k, arg_max_null(v, tx) AS v FROM {EV} GROUP BY ALL)"
CI = f"(SELECT CAST(floor(tx / 1000.0) AS BIGINT) AS step, k, count(DISTINCT tx) AS n, min(tx) AS first_tx, max(tx) AS last_tx FROM {EV} GROUP BY 1, 2)"


@query("c1_collate_index", f"SELECT step, k, n, first_tx, last_tx FROM {CI}")
def _(s, d):
    return lc.collate_index(events(s, d), STEP)


@query("c2_collate_history", f"SELECT CAST(floor(tx / 1000.0) AS BIGINT) AS step, k, tx, v, prev FROM (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY tx) AS prev FROM {EV})")
def _(s, d):
    from chronolake.operators.temporal import history

    h = history(events(s, d)).withColumn("step", lc.step_of(STEP))
    return h.repartitionByRange("k").sortWithinPartitions("k", "tx")


@query("c3_collate_domain", f"SELECT step, k, v FROM {CO}")
def _(s, d):
    return lc.collate_domain(events(s, d), STEP)


FI = r"""(SELECT file_id, CAST(regexp_extract(file_name, '^v(\d+)-(.+)\.(\d+)-(\d+)\.([a-z]+)$', 1) AS INT) AS version, regexp_extract(file_name, '^v(\d+)-(.+)\.(\d+)-(\d+)\.([a-z]+)$', 2) AS entity,
  CAST(regexp_extract(file_name, '^v(\d+)-(.+)\.(\d+)-(\d+)\.([a-z]+)$', 3) AS BIGINT) AS start_step, CAST(regexp_extract(file_name, '^v(\d+)-(.+)\.(\d+)-(\d+)\.([a-z]+)$', 4) AS BIGINT) AS end_step,
  regexp_extract(file_name, '^v(\d+)-(.+)\.(\d+)-(\d+)\.([a-z]+)$', 5) AS ext FROM files_item WHERE regexp_matches(file_name, '^v(\d+)-(.+)\.(\d+)-(\d+)\.([a-z]+)$'))"""


def file_ranges(s, d) -> DataFrame:
    return files.listing(table(s, d, "files_item").select("file_id", "file_name"), "file_name").drop("file_name")


@query("s1_merge_range", f"SELECT entity AS name, file_id, start_step, end_step, end_step - least(end_step & -end_step, 32) AS merge_from FROM {FI} WHERE end_step - least(end_step & -end_step, 32) < start_step")
def _(s, d):
    r = file_ranges(s, d).select(F.col("entity").alias("name"), "file_id", "start_step", "end_step")
    return lc.merge_candidates(r)


@query("s2_files_in_range", f"SELECT file_id FROM {FI} WHERE start_step >= 64 AND end_step <= 512")
def _(s, d):
    return file_ranges(s, d).where("start_step >= 64 and end_step <= 512").select("file_id")


@query(
    "s3_not_covered",
    f"""WITH f AS (SELECT DISTINCT entity AS name, start_step, end_step FROM {FI})
    SELECT name, start_step, end_step FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.name = a.name AND b.start_step <= a.start_step AND b.end_step >= a.end_step
      AND (b.start_step <> a.start_step OR b.end_step <> a.end_step))""",
)
def _(s, d):
    return lc.not_covered(file_ranges(s, d).select(F.col("entity").alias("name"), "start_step", "end_step"))


@query("s4_merge_domain", f"SELECT k, arg_max_null(v, step) AS v FROM {CO} WHERE step >= 0 AND step < 8 GROUP BY k HAVING arg_max_null(v, step) IS NOT NULL")
def _(s, d):
    return lc.merge_domain(lc.collate_domain(events(s, d), STEP), 0, 8)


@query("s4_merge_domain_half", f"SELECT k, arg_max_null(v, step) AS v FROM {CO} WHERE step < {AT_2} / 1000.0 GROUP BY k HAVING arg_max_null(v, step) IS NOT NULL")
def _(s, d):
    return lc.merge_domain(lc.collate_domain(events(s, d), STEP), 0, part_of_times(s, d, 2) / STEP)


@query("s4_merge_index", f"SELECT step // 4 AS span, k, CAST(sum(n) AS BIGINT) AS n, min(first_tx) AS first_tx, max(last_tx) AS last_tx FROM {CI} GROUP BY 1, 2")
def _(s, d):
    return lc.rollup_steps(lc.collate_index(events(s, d), STEP), 2)


@query("s5_merge_loop", f"SELECT step // 32 AS span, k, CAST(sum(n) AS BIGINT) AS n, min(first_tx) AS first_tx, max(last_tx) AS last_tx FROM {CI} GROUP BY 1, 2")
def _(s, d):
    c = lc.collate_index(events(s, d), STEP)
    for _level in range(5):
        c = lc.rollup_steps(c, 1).withColumnRenamed("span", "step")
    return c.withColumnRenamed("step", "span")


@query("s6_garbage_files", "SELECT file_id FROM files_item WHERE coalesce(can_delete, false)")
def _(s, d):
    return table(s, d, "files_item").where(F.coalesce("can_delete", F.lit(False))).select("file_id")


@query("s7_q1_file_names", f"SELECT file_id, version, entity, start_step, end_step, ext FROM {FI}")
def _(s, d):
    return file_ranges(s, d)


@query("a1_prune", f"SELECT k, tx, v FROM {EV} WHERE tx < 1000 OR tx >= 4000")
def _(s, d):
    return lc.prune(events(s, d), 1000, 4000).select("k", "tx", "v")


@query("a1_prune_domain", f"SELECT step, k, v FROM {CO} QUALIFY step >= 6 OR step = max(step) OVER (PARTITION BY k)")
def _(s, d):
    return lc.prune_domain(lc.collate_domain(events(s, d), STEP), 6)


@query("a3_unwind", f"SELECT k, arg_max_null(v, tx) AS v FROM {EV} WHERE tx < 7000 GROUP BY k")
def _(s, d):
    from chronolake.operators.temporal import latest

    return latest(lc.unwind(events(s, d), 7000))


@query("a3_unwind_half", f"SELECT k, arg_max_null(v, tx) AS v FROM {EV} WHERE tx < {AT_2} GROUP BY k")
def _(s, d):
    from chronolake.operators.temporal import latest

    return latest(lc.unwind(events(s, d), part_of_times(s, d, 2)))


@query("a4_can_prune_from", "SELECT least((SELECT min(event_id) FROM events), (SELECT min(o_orderkey) FROM orders)) AS first_tx")
def _(s, d):
    return lc.can_prune_from(events(s, d), order_pairs(s, d).withColumnRenamed("v", "tx"))


@query("a5_steps_range", f"SELECT min(tx) / 1000.0::DOUBLE AS first_step, max(tx) / 1000.0::DOUBLE AS last_step FROM {EV}")
def _(s, d):
    return lc.steps_range(events(s, d), STEP)


@query("a6_stats", f"SELECT step, count(*) AS keys, CAST(sum(n) AS BIGINT) AS entries FROM {CI} GROUP BY step")
def _(s, d):
    return lc.stats(lc.collate_index(events(s, d), STEP))


@query("a7_low_water_mark", f"SELECT min(m) AS mark FROM (SELECT max(tx) AS m FROM {EV} GROUP BY event_type UNION ALL SELECT max(tx) FROM {EV} GROUP BY k)")
def _(s, d):
    i = index(s, d).select(F.concat("name", F.lit("/"), "k").alias("name"), "tx")
    return lc.low_water_mark(i)


@query("a9_tiers", f"SELECT CAST(floor(tx / 1000.0) AS BIGINT) AS step, count(*) AS n, CASE WHEN floor(tx / 1000.0) > (SELECT max(floor(tx / 1000.0)) FROM {EV}) - 2 THEN 'hot' ELSE 'file' END AS tier FROM {EV} GROUP BY 1, 3")
def _(s, d):
    return lc.hot_steps(events(s, d), STEP, 2)


@query("a10_last_id", "SELECT max(tx_num) AS last_tx FROM change_log")
def _(s, d):
    return table(s, d, "change_log").agg(F.max("tx_num").alias("last_tx"))


# loading -----------------------------------------------------------------------------------------------------------------


@query("e1_e4_transform", f"WITH n AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_custkey >= 10 AND o_custkey < 900 GROUP BY 1) SELECT k, v FROM n UNION ALL SELECT k, v FROM {CU} WHERE k NOT IN (SELECT k FROM n)")
def _(s, d):
    src = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    return etl.transform(src, customers(s, d), outputs=[F.struct("k", "v")], start=10, end=900)


@query(
    "e1_transform_by_seq",
    f"""WITH n AS (SELECT k, arg_max(v, seq) AS v FROM (SELECT o_custkey AS k, o_totalprice AS v, o_orderkey * 2 AS seq FROM orders UNION ALL SELECT o_custkey + 1, -o_totalprice, o_orderkey * 2 + 1 FROM orders WHERE o_totalprice > 1000) GROUP BY 1)
    SELECT k, v FROM n UNION ALL SELECT k, v FROM {CU} WHERE k NOT IN (SELECT k FROM n)""",
)
def _(s, d):
    """The last order of each customer, and taken back of the customer before: two pairs a row, the last in order is loaded."""
    src = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))
    back = F.when(F.col("v") > 1000, F.struct((F.col("k") + 1).alias("k"), (-F.col("v")).alias("v")))
    return etl.transform(src, customers(s, d), outputs=[F.struct("k", "v"), back], seq="seq")


@query("e2_fan_out", "SELECT o_custkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT -o_custkey - 1, o_totalprice * 2 FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    src = table(s, d, "orders").withColumn("k", F.col("o_custkey"))
    two = F.when(F.col("o_orderstatus") == "F", F.struct((-F.col("k") - 1).alias("k"), (F.col("o_totalprice") * 2).alias("v")))
    return etl.extract(src, outputs=[F.struct("k", F.col("o_totalprice").alias("v")), two])


@query("e3_sort", "SELECT o_custkey AS k, o_orderkey AS seq, o_totalprice AS v FROM orders")
def _(s, d):
    return etl.sort_stable(_updates(s, d), "seq").select("k", "seq", "v")


@query("e5_keep_duplicates", "SELECT o_custkey AS k, o_totalprice AS v FROM orders")
def _(s, d):
    return etl.load_all(_updates(s, d))


@query("e6_append_values", "SELECT o_custkey AS k, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS v FROM orders GROUP BY 1")
def _(s, d):
    return etl.load_appended(table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("v")), "seq", "|")


@query("e7_oldest_appeared", "SELECT o_custkey AS k, arg_min_null(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1")
def _(s, d):
    return etl.load_oldest(_updates(s, d), "seq")


@query("e8_null_deletes", f"WITH n AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS v FROM supplier) SELECT k, v FROM n WHERE v IS NOT NULL UNION ALL SELECT k, v FROM {CU} WHERE k NOT IN (SELECT k FROM n) AND v IS NOT NULL")
def _(s, d):
    rows = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("v"))
    return etl.load_onto(customers(s, d), rows)


@query("e4_merge_with_target", f"SELECT coalesce(c.k, l.k) AS k, CASE WHEN l.k IS NULL THEN c.v ELSE l.v + coalesce(c.v, 0) END AS v FROM {CU} c FULL JOIN {LAST} l ON c.k = l.k")
def _(s, d):
    last = kv.put(customers(s, d).limit(0), _updates(s, d), "seq")
    return etl.load_onto(customers(s, d), last, F.col("v") + F.coalesce("old", F.lit(0.0)))


@query("e9_identity", f"SELECT k, v FROM {CU}")
def _(s, d):
    return etl.load_onto(customers(s, d).limit(0), customers(s, d))


@query("e13_progress", "SELECT arrival_id, CAST(floor((CAST('0x' || left(hex(id_hash), 2) AS INT) // 16) * 3.3) AS INT) AS percent FROM pool_txs WHERE id_hash IS NOT NULL")
def _(s, d):
    return table(s, d, "pool_txs").where("id_hash is not null").select("arrival_id", etl.progress(F.col("id_hash")).alias("percent"))


# overlays and caches --------------------------------------------------------------------------------------------------------

SU = "(SELECT s_suppkey AS k FROM supplier)"


def overlay_of(s, d) -> DataFrame:
    last = kv.put(customers(s, d).limit(0), _updates(s, d), "seq").where("k >= 50")
    return overlay.read_through(customers(s, d), last, table(s, d, "supplier").select(F.col("s_suppkey").alias("k")))


OV = f"(SELECT k, v FROM {LAST} WHERE k >= 50 UNION ALL SELECT k, v FROM {CU} WHERE k NOT IN (SELECT k FROM {LAST} WHERE k >= 50) AND k NOT IN (SELECT k FROM {SU}))"


@query("m1_overlay_read", f"SELECT k, v FROM {OV}")
def _(s, d):
    return overlay_of(s, d)


@query("m2_overlay_for_amount", f"SELECT k, v FROM {OV} WHERE k >= 20 ORDER BY k LIMIT 40")
def _(s, d):
    return kv.key_range(overlay_of(s, d), 20, limit=40)


MU = "(SELECT user_id AS k, arg_max(event_type, event_id) AS t, arg_max_null(value, event_id) AS v FROM events GROUP BY 1)"


def mutations(s, d):
    return overlay.compact_mutations(events(s, d).select(F.col("tx").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "k", "v"))


@query("m3_mutations", f"SELECT k, v FROM {MU} WHERE t <> 'error' UNION ALL SELECT k, v FROM {CU} WHERE k NOT IN (SELECT k FROM {MU})")
def _(s, d):
    puts, deletes = mutations(s, d)
    return overlay.read_through(customers(s, d), puts, deletes)


@query("m4_flush", f"SELECT k, v FROM {MU} WHERE t <> 'error'")
def _(s, d):
    puts, deletes = mutations(s, d)
    return overlay.read_through(customers(s, d), puts, deletes, cleared=True)


@query(
    "m5_diff",
    f"""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' ELSE 'update' END AS op, b.v
    FROM {CU} a FULL JOIN {OV} b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""",
)
def _(s, d):
    return overlay.diff(customers(s, d), overlay_of(s, d))


@query("m5_apply_diff", f"SELECT k, v FROM {OV}")
def _(s, d):
    return overlay.apply_diff(customers(s, d), overlay.diff(customers(s, d), overlay_of(s, d)))


CH = "(SELECT event_id // 500 AS version, user_id AS k, CASE WHEN event_type <> 'error' THEN value END AS v, event_id FROM events)"


def cache_changes(s, d) -> DataFrame:
    last = events(s, d).groupBy(F.floor(F.col("tx") / 500).cast("bigint").alias("version"), "k").agg(F.max(F.struct("tx", "event_type", "v")).alias("x"))
    return last.select("version", "k", F.when(F.col("x.event_type") != "error", F.col("x.v")).alias("v"))


@query("v1_view", f"SELECT k, arg_max_null(v, event_id) AS v FROM {CH} WHERE version <= 10 GROUP BY k")
def _(s, d):
    return overlay.view_at(cache_changes(s, d), 10)


@query("v2_on_new_block", f"SELECT version, k, arg_max_null(v, event_id) AS v FROM {CH} GROUP BY 1, 2")
def _(s, d):
    return cache_changes(s, d)


CA = f"(SELECT k, arg_max_null(v, event_id) AS v FROM {CH} GROUP BY k)"


@query("v3_get_through", f"SELECT o.k, CASE WHEN c.k IS NOT NULL THEN c.v ELSE b.v END AS v, c.k IS NOT NULL AS hit FROM (SELECT DISTINCT k FROM {OP}) o LEFT JOIN {CA} c ON c.k = o.k LEFT JOIN {CU} b ON b.k = o.k")
def _(s, d):
    return overlay.get_through(overlay.view_at(cache_changes(s, d), 10**9), customers(s, d), order_pairs(s, d))


@query("v4_evict", "SELECT k, size, used, total FROM (SELECT o_orderkey AS k, CAST(strlen(o_orderpriority) AS INT) AS size, o_orderkey AS used, CAST(sum(strlen(o_orderpriority)) OVER (ORDER BY o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM orders) WHERE total <= 20000")
def _(s, d):
    return overlay.evict(table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.octet_length("o_orderpriority").alias("size"), F.col("o_orderkey").alias("used")), 20_000)


@query("v4_keep_versions", f"SELECT version, k, arg_max_null(v, event_id) AS v FROM {CH} WHERE version > (SELECT max(version) FROM {CH}) - 5 GROUP BY 1, 2")
def _(s, d):
    return overlay.keep_versions(cache_changes(s, d), 5)


@query("v5_validate", f"SELECT c.k, c.v AS cached, b.v AS stored FROM {CA} c LEFT JOIN {CU} b ON b.k = c.k WHERE c.v IS DISTINCT FROM b.v")
def _(s, d):
    return overlay.incoherent(overlay.view_at(cache_changes(s, d), 10**9), customers(s, d))


@query("v6_stats", f"SELECT version, count(DISTINCT k) AS n, CAST(sum(count(DISTINCT k)) OVER (ORDER BY version) AS BIGINT) AS total FROM {CH} GROUP BY version")
def _(s, d):
    return overlay.versions(cache_changes(s, d))


# remote reads, transfer figures ---------------------------------------------------------------------------------------------


@query("g2_range_page", f"SELECT k, v FROM {CU} WHERE k > 99 ORDER BY k LIMIT 64")
def _(s, d):
    return streams.page(customers(s, d), "k", 99, 64)


@query("g3_index_page", f"SELECT tx FROM {EV} WHERE event_type = 'click' AND tx > 2000 ORDER BY tx LIMIT 128")
def _(s, d):
    return streams.page(events(s, d).where("event_type = 'click'").select("tx"), "tx", 2000, 128)


@query("g6_snapshots", "SELECT snap_no, tx_num, complete FROM snapshot_runs")
def _(s, d):
    return table(s, d, "snapshot_runs").select("snap_no", "tx_num", "complete")


@query(
    "q2_transfer_stats",
    """SELECT run_id, rows_read - lag(rows_read) OVER (ORDER BY cutoff_at, run_id) AS delta, least(100.0::DOUBLE * rows_read / (SELECT max(rows_read) FROM ingest_runs), 99.99::DOUBLE) AS progress
    FROM ingest_runs WHERE status = 'ok'""",
)
def _(s, d):
    r = table(s, d, "ingest_runs").where("status = 'ok'").select("run_id", "cutoff_at", "rows_read")
    most = table(s, d, "ingest_runs").agg(F.max("rows_read")).scalar()
    r = neighbour(r, keys=[], time="cutoff_at", ties=["run_id"], take={"before": "rows_read"})
    return r.select("run_id", (F.col("rows_read") - F.col("before")).alias("delta"), F.least(F.lit(100.0) * F.col("rows_read") / most, F.lit(99.99)).alias("progress"))


@query("q4_completion_flags", "SELECT series, bool_and(coalesce(frozen, false)) AS complete FROM files_item GROUP BY series")
def _(s, d):
    return table(s, d, "files_item").groupBy("series").agg(F.bool_and(F.coalesce("frozen", F.lit(False))).alias("complete"))


# word files -------------------------------------------------------------------------------------------------------------------


@query("z2_frequent_substrings", "SELECT pattern, n, (n - 1) * length(pattern) AS score FROM (SELECT substr(p_name, CAST(a AS INT), CAST(l AS INT)) AS pattern, count(*) AS n FROM part, range(5, 9) l(l), range(1, 64) a(a) WHERE a + l - 1 <= length(p_name) GROUP BY 1) WHERE n >= 2")
def _(s, d):
    return formats.frequent_substrings(table(s, d, "part"), "p_name", 5, 8)


@query(
    "z2_frequent_substrings_whole",
    """SELECT pattern, n, (n - 1) * length(pattern) AS score FROM (
      SELECT substr(p_name, CAST(a AS INT), CAST(l AS INT)) AS pattern, count(*) AS n
      FROM (SELECT p_name, l, unnest(range(1, length(p_name) - l + 2)) AS a FROM (SELECT p_name, unnest(range(5, least(length(p_name), 128) + 1)) AS l FROM part)) GROUP BY 1
    ) WHERE n >= 2""",
)
def _(s, d):
    """All lengths of Z2; z2_frequent_substrings has those up to 8 only."""
    return formats.frequent_substrings(table(s, d, "part"), "p_name", formats.SHORTEST_PATTERN, formats.LONGEST_PATTERN)


@query("z4_dictionary_scores", "SELECT word, count(*) * length(word) AS score FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def _(s, d):
    return formats.word_scores(table(s, d, "documents"), "text")


@query("z5_top_words", "SELECT word, count(*) * length(word) AS score FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY score DESC, word DESC LIMIT 1000")
def _(s, d):
    return formats.build_dictionary(formats.word_scores(table(s, d, "documents"), "text"), 1000)


@query("z5_dictionary", "SELECT word, count(*) * length(word) AS score FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY score DESC, word DESC LIMIT 65536")
def _(s, d):
    """The dictionary in its full size; z5_top_words has its first 1,000 words only."""
    return formats.build_dictionary(formats.word_scores(table(s, d, "documents"), "text"))


@query("z7_words", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS n, p_name AS word FROM part")
def _(s, d):
    return kv.sequence(table(s, d, "part").select("p_partkey", F.col("p_name").alias("word")), "p_partkey").select(F.col("seq").alias("n"), "word")


@query("z8_match", "SELECT p_partkey, p_name = 'small ring' AS equal, starts_with(p_name, 'small') AS prefix, CASE WHEN p_name < 'red' THEN -1 WHEN p_name = 'red' THEN 0 ELSE 1 END AS cmp, CASE WHEN starts_with(p_name, 'red') THEN 0 WHEN p_name < 'red' THEN -1 ELSE 1 END AS cmp_prefix FROM part")
def _(s, d):
    w = F.col("p_name")
    return table(s, d, "part").select("p_partkey", (w == "small ring").alias("equal"), w.startswith("small").alias("prefix"), formats.compare(w, F.lit("red")).alias("cmp"), formats.compare_prefix(w, "red").alias("cmp_prefix"))


@query("z9_word_stats", "SELECT count(text) AS n, count(*) FILTER (WHERE text = '') AS empty, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents")
def _(s, d):
    return formats.word_stats(table(s, d, "documents"), "text")


@query("z10_offsets", "SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal, CAST(sum(strlen(p_name)) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) - strlen(p_name) AS BIGINT) AS start FROM part")
def _(s, d):
    return formats.offset_index(table(s, d, "part").select(F.col("p_partkey").alias("k"), F.octet_length("p_name").alias("size")), "size")


@query("z10_repeated_keys", f"SELECT k, count(*) AS n FROM {OP} GROUP BY k HAVING count(*) > 1")
def _(s, d):
    return formats.repeated_keys(order_pairs(s, d))


@query("z11_ordinals", f"SELECT k, row_number() OVER (ORDER BY k) - 1 AS ordinal FROM (SELECT DISTINCT k FROM {OP})")
def _(s, d):
    return formats.ordinals(order_pairs(s, d))


@query("z12_search", "SELECT p.probe, min(f.k) AS k FROM (SELECT DISTINCT s_suppkey * 50 AS probe FROM supplier) p JOIN (SELECT DISTINCT start_tx_num AS k FROM files_item) f ON f.k >= p.probe GROUP BY p.probe")
def _(s, d):
    return kv.seek(table(s, d, "files_item").select(F.col("start_tx_num").alias("k")).distinct(), table(s, d, "supplier").select((F.col("s_suppkey") * 50).alias("probe")))


@query("z14_lower_bound", "SELECT p.probe, min(h.k) AS k FROM (SELECT DISTINCT k AS probe FROM recon_items WHERE k IS NOT NULL) p JOIN (SELECT DISTINCT k FROM history_vals) h ON h.k >= p.probe GROUP BY p.probe")
def _(s, d):
    return kv.seek(table(s, d, "history_vals").select("k").distinct(), table(s, d, "recon_items").select(F.col("k").alias("probe")))


@query(
    "z15_longest_matches",
    """WITH p AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS pattern FROM part),
    m AS (SELECT d.p_partkey, CAST(a - 1 AS INT) AS "begin", max(length(pattern)) AS len FROM (SELECT p_partkey, p_name || p_name AS t FROM part) d, range(1, 64) r(a), p
      WHERE a <= length(t) AND substr(t, CAST(a AS INT), CAST(length(pattern) AS INT)) = pattern GROUP BY 1, 2),
    e AS (SELECT *, max("begin" + len) OVER (PARTITION BY p_partkey ORDER BY "begin" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM m)
    SELECT p_partkey, "begin", CAST("begin" + len AS INT) AS "end", substr(t, "begin" + 1, CAST(len AS INT)) AS pattern FROM e JOIN (SELECT p_partkey, p_name || p_name AS t FROM part) USING (p_partkey)
    WHERE reached IS NULL OR "begin" + len > reached""",
)
def _(s, d):
    part = table(s, d, "part")
    texts = part.select("p_partkey", F.concat("p_name", "p_name").alias("t"))
    patterns = part.select(F.explode(F.split("p_name", " ")).alias("pattern"))
    return formats.longest_matches(texts, patterns, text_id="p_partkey", text="t", pattern="pattern")


# pools --------------------------------------------------------------------------------------------------------------------------


def txs(s, d) -> DataFrame:
    return table(s, d, "pool_txs")


@query("pool1_mined_by_block", "SELECT block_added, count(*) AS n, count(DISTINCT sender_id) AS senders, max(nonce) AS max_nonce FROM pool_txs WHERE block_added IS NOT NULL GROUP BY 1")
def _(s, d):
    return txs(s, d).where("block_added is not null").groupBy("block_added").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sender_id").alias("senders"), F.max("nonce").alias("max_nonce"))


GAS_PER_BLOB, BLOBS_PER_BLOCK = 131_072, 6


@query(
    "pool4_best",
    """WITH RECURSIVE o AS (
      SELECT *, row_number() OVER (ORDER BY tip DESC, arrival_id DESC) AS rn FROM (
        SELECT sender_id, nonce, tip, arrival_id, gas, coalesce(len(blob_hashes), 0) * 131072 AS blob FROM pool_txs QUALIFY row_number() OVER (PARTITION BY sender_id, nonce ORDER BY tip DESC, arrival_id DESC) = 1
      ) WHERE gas > 0
    ), g(rn, gas_left, blob_left, n, took) AS (
      SELECT CAST(0 AS BIGINT), CAST(30000000 AS BIGINT), CAST(786432 AS BIGINT), CAST(0 AS BIGINT), false
      UNION ALL
      SELECT o.rn, gas_left - CASE WHEN fits THEN gas ELSE 0 END, blob_left - CASE WHEN fits THEN blob ELSE 0 END, n + CASE WHEN fits THEN 1 ELSE 0 END, fits
      FROM (SELECT g.gas_left, g.blob_left, g.n, o.*, o.gas <= g.gas_left AND o.blob <= g.blob_left AND g.n < 10000 AS fits FROM g JOIN o ON o.rn = g.rn + 1) o
    )
    SELECT sender_id, nonce, CAST(tip AS VARCHAR) AS tip, arrival_id, gas FROM o JOIN g USING (rn) WHERE took""",
)
def _(s, d):
    """The most generous transactions that fit into a block, one after another: their gas, and the gas of their blobs."""
    blobs = (F.coalesce(F.array_size("blob_hashes"), F.lit(0)) * GAS_PER_BLOB).alias("blob_gas")
    one = pool.per_slot(txs(s, d).select("sender_id", "nonce", "tip", "arrival_id", "gas", blobs), ["sender_id", "nonce"], ["tip", "arrival_id"])
    best = pool.pick_greedily(one, order=["tip", "arrival_id"], cost=["gas", "blob_gas"], budget=[30_000_000, BLOBS_PER_BLOCK * GAS_PER_BLOB], most=10_000)
    return best.drop("blob_gas").withColumn("tip", F.col("tip").cast("string"))


@query("pool5_order", "SELECT arrival_id, CAST(tip AS VARCHAR) AS tip, nonce FROM pool_txs ORDER BY pool_txs.tip DESC, nonce, arrival_id LIMIT 500")
def _(s, d):
    return txs(s, d).orderBy(F.desc("tip"), "nonce", "arrival_id").limit(500).select("arrival_id", F.col("tip").cast("string").alias("tip"), "nonce")


SLOT = "(SELECT * FROM pool_txs QUALIFY row_number() OVER (PARTITION BY sender_id, nonce ORDER BY tip DESC, fee_cap DESC, arrival_id DESC) = 1)"


def slots(s, d) -> DataFrame:
    cols = ["sender_id", "nonce", "tip", "fee_cap", "arrival_id", "gas", "tx_value", "tx_type", "is_local", "block_added"]
    return pool.per_slot(txs(s, d).select(*cols), ["sender_id", "nonce"], ["tip", "fee_cap", "arrival_id"])


@query("pool6_one_per_slot", f"SELECT sender_id, nonce, arrival_id FROM {SLOT}")
def _(s, d):
    return slots(s, d).select("sender_id", "nonce", "arrival_id")


@query("pool7_unknown_hashes", "SELECT DISTINCT lower(hex(id_hash)) AS id_hash FROM pool_txs WHERE id_hash IS NOT NULL AND tx_type = 2 AND id_hash NOT IN (SELECT id_hash FROM pool_txs WHERE tx_type IN (0, 1, 3) AND id_hash IS NOT NULL)")
def _(s, d):
    t = txs(s, d)
    found = pool.unknown(t.where("tx_type = 2"), *[t.where(F.col("tx_type") == i) for i in (0, 1, 3)], key="id_hash")
    return found.select(F.lower(F.hex("id_hash")).alias("id_hash"))


@query("pool8_count_content", "SELECT tx_type, is_local, count(*) AS n, CAST(coalesce(sum(len(blob_hashes)), 0) AS BIGINT) AS blobs FROM pool_txs GROUP BY 1, 2")
def _(s, d):
    blobs = F.coalesce(F.sum(F.when(F.col("blob_hashes").isNotNull(), F.size("blob_hashes"))), F.lit(0))
    return txs(s, d).groupBy("tx_type", "is_local").agg(F.count(F.lit(1)).alias("n"), blobs.alias("blobs"))


@query("pool8_nonce_of_sender", "SELECT sender_id, max(nonce) AS nonce FROM pool_txs GROUP BY 1")
def _(s, d):
    return txs(s, d).groupBy("sender_id").agg(F.max("nonce").alias("nonce"))


@query("pool9_remove_mined", "SELECT arrival_id FROM pool_txs t LEFT JOIN (SELECT sender_id AS sid, max(nonce) AS done FROM pool_txs WHERE is_local GROUP BY 1) m ON m.sid = t.sender_id WHERE done IS NULL OR nonce > done")
def _(s, d):
    return pool.without_done(txs(s, d), txs(s, d).where("is_local"), "sender_id", "nonce").select("arrival_id")


@query(
    "pool10_running_conditions",
    f"""WITH b AS (SELECT *, min(nonce) OVER (PARTITION BY sender_id) AS base FROM {SLOT})
    SELECT sender_id, nonce, CAST(min(fee_cap) OVER o AS VARCHAR) AS min_fee_cap, CAST(min(tip) OVER o AS VARCHAR) AS min_tip, CAST(sum(gas) OVER o AS BIGINT) AS gas_so_far, nonce = base + row_number() OVER (PARTITION BY sender_id ORDER BY nonce) - 1 AS no_gap
    FROM b WINDOW o AS (PARTITION BY sender_id ORDER BY nonce ROWS UNBOUNDED PRECEDING)""",
)
def _(s, d):
    one = slots(s, d)
    base = one.groupBy("sender_id").agg(F.min("nonce").alias("base"))
    r = pool.running_conditions(one.join(base, "sender_id"), owner="sender_id", number="nonce", base="base", sums={"gas_so_far": "gas"}, mins={"min_fee_cap": "fee_cap", "min_tip": "tip"})
    return r.select("sender_id", "nonce", F.col("min_fee_cap").cast("string").alias("min_fee_cap"), F.col("min_tip").cast("string").alias("min_tip"), "gas_so_far", "no_gap")


@query("pool11_capacity", "SELECT tx_type, arrival_id FROM pool_txs QUALIFY row_number() OVER (PARTITION BY tx_type ORDER BY tip DESC, arrival_id) <= 1000")
def _(s, d):
    return pool.keep_best(txs(s, d), "tx_type", [F.desc("tip"), F.asc("arrival_id")], 1000).select("tx_type", "arrival_id")


@query("pool12_not_final", "SELECT arrival_id FROM pool_txs WHERE block_added > 21000100")
def _(s, d):
    return txs(s, d).where("block_added > 21000100").select("arrival_id")


@query("pool13_drop_upper_half", "SELECT arrival_id FROM pool_txs QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY nonce, arrival_id) <= count(*) OVER (PARTITION BY sender_id) - count(*) OVER (PARTITION BY sender_id) // 2")
def _(s, d):
    return pool.drop_upper_half(txs(s, d), "sender_id", "nonce", "arrival_id").select("arrival_id")


@query("pool14_reasons", "SELECT lower(hex(a.id_hash)) AS id_hash, coalesce(max(r.reason), 'not known') AS reason FROM (SELECT DISTINCT id_hash FROM pool_txs WHERE id_hash IS NOT NULL) a LEFT JOIN (SELECT id_hash, 'mined' AS reason FROM pool_txs WHERE block_added IS NOT NULL) r ON r.id_hash = a.id_hash GROUP BY a.id_hash")
def _(s, d):
    known = txs(s, d).where("block_added is not null").select("id_hash", F.lit("mined").alias("reason"))
    return pool.reasons(txs(s, d), known, "id_hash", "not known").select(F.lower(F.hex("id_hash")).alias("id_hash"), "reason")


@query("pool15_required", "SELECT arrival_id, CAST(CAST(gas AS DECIMAL(20,0)) * CAST(fee_cap AS DECIMAL(18,0)) + CAST(tx_value AS DECIMAL(38,0)) AS VARCHAR) AS required FROM pool_txs")
def _(s, d):
    cost = F.try_add(F.try_multiply(F.col("gas").cast("decimal(20,0)"), F.col("fee_cap").cast("decimal(18,0)")), F.col("tx_value"))
    return txs(s, d).select("arrival_id", pool.saturating(cost.cast("decimal(38,0)")).cast("string").alias("required"))


@query("pool16_announcements", "SELECT lower(hex(id_hash)) AS id_hash, min(tx_type) AS tx_type, bool_or(is_local) AS is_local FROM pool_txs WHERE id_hash IS NOT NULL GROUP BY id_hash")
def _(s, d):
    g = txs(s, d).where("id_hash is not null").groupBy("id_hash").agg(F.min("tx_type").alias("tx_type"), F.bool_or("is_local").alias("is_local"))
    return g.withColumn("id_hash", F.lower(F.hex("id_hash")))


@query("pool17_sender_ids", "SELECT sender_id, dense_rank() OVER (ORDER BY sender_id) AS id FROM (SELECT DISTINCT sender_id FROM pool_txs)")
def _(s, d):
    return pool.dense_ids(txs(s, d), "sender_id")


# scalars and codecs -------------------------------------------------------------------------------------------------------------


@query("f1_u64", "SELECT o_orderkey, lpad(lower(to_hex(o_orderkey)), 16, '0') AS hexed, CAST(o_orderkey AS VARCHAR) AS back FROM orders")
def _(s, d):
    x = F.col("o_orderkey")
    return table(s, d, "orders").select(x, codec.u64_hex(x).alias("hexed"), codec.u64_from_bytes(codec.u64_bytes(x)).cast("string").alias("back"))


@query("f2_hex", "SELECT row_id, lower(address) AS round_trip, regexp_matches(coalesce(code_hash, ''), '^0x([0-9a-fA-F]{2})+$') AS code_is_hex FROM account_snapshots")
def _(s, d):
    code = F.coalesce("code_hash", F.lit(""))
    return table(s, d, "account_snapshots").select("row_id", codec.hex_encode(codec.hex_decode(F.col("address"))).alias("round_trip"), (codec.has_0x(code) & codec.is_hex(F.substring(code, 3, 1 << 30))).alias("code_is_hex"))


@query("f3_clamp", "SELECT c_custkey, greatest(0.0::DOUBLE, least(5000.0::DOUBLE, c_acctbal)) AS clamped FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", codec.clamp(F.col("c_acctbal"), F.lit(0.0), F.lit(5000.0)).alias("clamped"))


@query(
    "f4_safe_math",
    """SELECT arrival_id, CAST(CASE WHEN CAST(tip AS HUGEINT) + fee_cap::HUGEINT <= 18446744073709551615 THEN tip::HUGEINT + fee_cap::HUGEINT END AS VARCHAR) AS added,
    CAST(CASE WHEN tip::HUGEINT * gas::HUGEINT <= 18446744073709551615 THEN tip::HUGEINT * gas::HUGEINT END AS VARCHAR) AS multiplied FROM pool_txs""",
)
def _(s, d):
    t, f, g = F.col("tip"), F.col("fee_cap"), F.col("gas").cast("decimal(20,0)")
    return txs(s, d).select("arrival_id", codec.safe_add(t, f).cast("string").alias("added"), codec.safe_mul(t, g).cast("string").alias("multiplied"))


@query("f6_bit_lengths", "SELECT l_orderkey, l_linenumber, CAST(ceil(l_quantity / 8) AS BIGINT) AS bytes FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", codec.bytes_of_bits(F.col("l_quantity")).alias("bytes"))


@query("f5_byte_count", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%d B', n_chars) WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0) ELSE printf('%.1f MB', n_chars / 1048576.0) END AS size FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", codec.byte_count(F.col("n_chars")).alias("size"))


@query("f7_fixed_width", "SELECT arrival_id, lower(right(lpad(hex(id_hash), CAST(greatest(40, length(hex(id_hash))) AS INT), '0'), 40)) AS address FROM pool_txs WHERE id_hash IS NOT NULL")
def _(s, d):
    return txs(s, d).where("id_hash is not null").select("arrival_id", F.lower(F.hex(codec.to_width(F.col("id_hash"), 20))).alias("address"))


@query("f7_is_address", "SELECT row_id, regexp_matches(address, '^(0[xX])?[0-9a-fA-F]{40}$') AS ok FROM account_snapshots")
def _(s, d):
    return table(s, d, "account_snapshots").select("row_id", codec.is_address(F.col("address")).alias("ok"))


@query("f15_nested_sizes", "SELECT arrival_id, coalesce(len(blob_hashes), 0)::INT AS n FROM pool_txs")
def _(s, d):
    return txs(s, d).select("arrival_id", F.coalesce(codec.nested_sizes(F.array("blob_hashes")), F.lit(0)).alias("n"))


@query("f18_versioned_hash", "SELECT arrival_id, '01' || substr(sha256(id_hash), 3) AS versioned FROM pool_txs WHERE id_hash IS NOT NULL")
def _(s, d):
    return txs(s, d).where("id_hash is not null").select("arrival_id", F.concat(F.lit("01"), F.sha2("id_hash", 256).substr(3, 62)).alias("versioned"))


@query("f19_split_args", "SELECT p_partkey, len(list_filter(list_transform(string_split(replace(p_name, ' ', ' , ') || ', ', ','), lambda x: trim(x)), lambda y: y <> ''))::INT AS n FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.size(codec.csv_args(F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(", ")))).alias("n"))


@query("f9_f8_rlp_round_trip", "SELECT row_id, nonce, CAST(balance AS VARCHAR) AS balance FROM account_snapshots WHERE balance IS NOT NULL")
def _(s, d):
    from chronolake.functions.accounts import decode_account, encode_account

    a = table(s, d, "account_snapshots").where("balance is not null").select("row_id", encode_account(F.col("nonce"), F.col("balance").cast("string")).alias("enc"))
    return a.select("row_id", decode_account("enc").alias("x")).select("row_id", "x.nonce", "x.balance")


@query(
    "l2_config_as_of",
    "SELECT t.tx, max(s.tx_num) AS since, arg_max(s.snap_no, s.tx_num) AS snap_no FROM (SELECT DISTINCT tx_num + nonce AS tx FROM account_snapshots) t JOIN snapshot_runs s ON s.tx_num <= t.tx GROUP BY t.tx",
)
def _(s, d):
    asked = table(s, d, "account_snapshots").select((F.col("tx_num") + F.col("nonce")).alias("tx")).distinct().withColumn("__one", F.lit(0))
    keyed = table(s, d, "snapshot_runs").select(F.lit(0).alias("__one"), F.col("tx_num").alias("since"), "snap_no")
    return as_known_at(asked, keyed, key="__one", event_time="tx", order=["since"], available=["since"], payload=["snap_no"]).select("tx", "since", "snap_no")


@query("l5_chained_lookups", "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    by_customer = li.join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("n"))
    places = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = by_customer.join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("r_name").agg(F.sum("n").alias("n"))


# hash trees -----------------------------------------------------------------------------------------------------------------------


@query("t1_state_root")
def _(s, d):
    """The root of the accounts after the last snapshot: those of the last complete one, as incomplete ones since then have
    changed them. The latest row of an account counts; if that has no balance, or the account isn't there, it has no leaf."""
    runs = table(s, d, "snapshot_runs").where("tx_num is not null")
    since = runs.where("complete").agg(F.coalesce(F.max("tx_num"), F.lit(-(2**63)))).scalar()
    a = table(s, d, "account_snapshots").where("address is not null").where(F.col("tx_num") >= since).join(runs.select("tx_num"), "tx_num", "left_semi")
    last = a.groupBy(F.lower("address").alias("address")).agg(F.max(F.struct("tx_num", "row_id", "nonce", "balance")).alias("x")).where("x.balance is not null")
    return commitment.state_root(last.select(codec.hex_decode(F.col("address")).alias("k"), commitment.account_value("x.nonce", F.col("x.balance").cast("string")).alias("v")))


@query("t5_merge_branches", "SELECT user_id AS prefix, bit_or(CAST(1 << CAST(nibble AS INT) AS INT)) AS touched, bit_or(CASE WHEN t <> 'error' THEN CAST(1 << CAST(nibble AS INT) AS INT) ELSE 0 END) AS present FROM (SELECT user_id, event_id % 16 AS nibble, arg_max(event_type, event_id) AS t FROM events GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    up = events(s, d).select(F.col("tx").alias("seq"), F.col("k").alias("prefix"), (F.col("tx") % 16).cast("int").alias("nibble"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("cell"))
    return commitment.merge_branches(up)


@query("t6_touched_keys")
def _(s, d):
    return commitment.touched_keys(events(s, d), 5000)


@query("t7_references", "SELECT sender_id, arrival_id, dense_rank() OVER (ORDER BY sender_id) - 1 AS ref FROM pool_txs")
def _(s, d):
    ids = pool.dense_ids(txs(s, d), "sender_id")
    return txs(s, d).select("sender_id", "arrival_id").join(ids, "sender_id").select("sender_id", "arrival_id", (F.col("id") - 1).alias("ref"))


# streams of state changes ------------------------------------------------------------------------------------------------------------


@query(
    "g5_state_with_rollbacks",
    """WITH c AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'UNWIND' ELSE 'FORWARD' END AS direction, user_id AS k, CASE WHEN event_type = 'error' THEN event_id - 3 ELSE event_id END AS tx, value AS v FROM events),
    e AS (SELECT * FROM c f WHERE direction = 'FORWARD' AND NOT EXISTS (SELECT 1 FROM c u WHERE u.direction = 'UNWIND' AND u.seq > f.seq AND u.tx <= f.tx))
    SELECT k, arg_max_null(v, tx) AS v FROM e GROUP BY k""",
)
def _(s, d):
    from chronolake.operators.temporal import latest
    from chronolake.streaming.state_changes import effective

    is_error = F.col("event_type") == "error"
    c = events(s, d).select(F.col("tx").alias("seq"), F.when(is_error, "UNWIND").otherwise("FORWARD").alias("direction"), "k", F.when(is_error, F.col("tx") - 3).otherwise(F.col("tx")).alias("tx"), "v")
    return latest(effective(c))


@query("v2_stream_latest", f"SELECT k, arg_max_null(v, tx) AS v FROM {EV} GROUP BY k HAVING arg_max_null(v, tx) IS NOT NULL")
def _(s, d):
    """The latest value of each user, by a stream that reads the events folder once and ends."""
    import uuid

    from chronolake.session import shared_dir
    from chronolake.streaming.state_changes import StateTable

    name = uuid.uuid4().hex
    at = f"{shared_dir(s)}/stream-{name}"
    src = f"{at}/source"
    events(s, d).select(F.col("tx").alias("seq"), F.lit("FORWARD").alias("direction"), "k", "tx", "v").write.parquet(src)
    stream = s.readStream.schema("seq bigint, direction string, k bigint, tx bigint, v double").parquet(src)
    state = StateTable(s, f"{at}/table")
    state.follow(stream, f"{at}/checkpoint").awaitTermination()
    return state.state()
