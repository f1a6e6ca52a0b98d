"""Queries p1 to p6 over the change-log tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.operators.asof import as_known_at
from chronolake.operators.cuckoo import ask_filters, audit, seen_before, update_filters
from chronolake.operators.intervals import periods_and_gaps
from chronolake.operators.ledger import Ledger, new_or_changed, run_gaps, sequence_of
from chronolake.operators.merkle import SnapshotHistory, history_from_snapshots
from chronolake.operators.salted import index_entries
from chronolake.plans.registry import core
from chronolake.session import materialize, shared_dir, table


@core.query(
    "p1_found",
    """
    SELECT e.recon_id, h.hist_id
    FROM recon_items e JOIN history_vals h ON h.k = e.k AND h.tx_num <= e.tx_num AND h.known_tx <= e.tx_num
    QUALIFY row_number() OVER (PARTITION BY e.recon_id ORDER BY h.tx_num DESC, h.known_tx DESC, h.hist_id DESC) = 1
    """,
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "recon_items").select("recon_id", "k", F.col("tx_num").alias("event_tx"))
    return as_known_at(
        events, table(spark, sf_dir, "history_vals"), key="k", event_time="event_tx", order=["tx_num", "known_tx", "hist_id"], available=["tx_num", "known_tx"]
    ).select("recon_id", "hist_id")


@core.query(
    "p1_values",
    """
    SELECT e.recon_id, e.k, e.tx_num AS event_tx, h.hist_id, h.v, h.prev
    FROM recon_items e LEFT JOIN (
      SELECT e.recon_id AS rid, h.* FROM recon_items e JOIN history_vals h ON h.k = e.k AND h.tx_num <= e.tx_num AND h.known_tx <= e.tx_num
      QUALIFY row_number() OVER (PARTITION BY e.recon_id ORDER BY h.tx_num DESC, h.known_tx DESC, h.hist_id DESC) = 1
    ) h ON h.rid = e.recon_id
    """,
)
def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "recon_items").select("recon_id", "k", F.col("tx_num").alias("event_tx"))
    versions = table(spark, sf_dir, "history_vals")
    found = as_known_at(
        events, versions, key="k", event_time="event_tx", order=["tx_num", "known_tx", "hist_id"], available=["tx_num", "known_tx"], payload=["v", "prev"], prefix="as_of_", how="left"
    )
    return found.select("recon_id", "k", "event_tx", F.col("as_of_hist_id").alias("hist_id"), F.col("as_of_v").alias("v"), F.col("as_of_prev").alias("prev"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_gaps(table(spark, sf_dir, "ingest_runs"), run_id="run_id", cutoff="cutoff_at", ok=F.col("status") == "ok")


@core.query(
    "p2_found",
    """
    WITH r AS (
      SELECT run_id, cutoff_at, row_number() OVER (ORDER BY cutoff_at, run_id) AS rk, lag(cutoff_at) OVER (ORDER BY cutoff_at, run_id) AS before
      FROM ingest_runs WHERE status = 'ok' AND cutoff_at IS NOT NULL
    ), t AS (
      SELECT r.run_id, r.rk, c.* FROM change_log c JOIN r ON c.arrived_at <= r.cutoff_at AND (r.before IS NULL OR c.arrived_at > r.before)
      WHERE c.k IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY c.k, c.tx_num, r.rk ORDER BY c.arrived_at DESC, c.change_id DESC) = 1
    ), w AS (
      SELECT *, lag(rk) OVER o AS prk, lag(v) OVER o AS pv FROM t WINDOW o AS (PARTITION BY k, tx_num ORDER BY rk)
    )
    SELECT run_id, change_id FROM w WHERE prk IS NULL OR v IS DISTINCT FROM pv
    """,
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "change_log").where("k is not null")
    return new_or_changed(log, _gaps(spark, sf_dir), record=["k", "tx_num"], seq=sequence_of(F.col("arrived_at")), tie="change_id", values=["v"], keep=["change_id"]).select(
        "run_id", "change_id"
    )


@core.query(
    "p2_run_gaps",
    """
    WITH r AS (
      SELECT run_id, epoch_us(cutoff_at) + 1 AS hi, max(epoch_us(cutoff_at) + 1) OVER (ORDER BY cutoff_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo
      FROM ingest_runs WHERE status = 'ok' AND cutoff_at IS NOT NULL
    )
    SELECT run_id, lo AS from_us, hi AS to_us FROM r WHERE lo IS NULL OR lo < hi
    """,
)
def p2_run_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gaps(spark, sf_dir)
    return g.select("run_id", F.when(F.col("__rank") > 1, F.col("__lo")).alias("from_us"), F.col("__hi").alias("to_us"))


@core.query(
    "p2_ledger",
    """
    SELECT min(change_id) AS lo, max(change_id) + 1 AS hi
    FROM (SELECT change_id, change_id - row_number() OVER (ORDER BY change_id) AS g FROM change_log) GROUP BY g
    """,
)
def p2_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ledger has processed after two runs: one when only the rows of successful runs had arrived, one with all rows,
    late ones included."""
    log = table(spark, sf_dir, "change_log").select("change_id", "k", "v", "arrived_at")
    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    cut = table(spark, sf_dir, "ingest_runs").where("status = 'ok'").agg(F.max("cutoff_at")).scalar()
    ledger.run(log.where(F.col("arrived_at") <= cut), "change_id", lambda df: df.select("change_id", "k"))
    ledger.run(log, "change_id", lambda df: df.select("change_id", "k"))
    return ledger.processed()


@core.query(
    "p3_found",
    """
    WITH r AS (
      SELECT DISTINCT series, start_tx_num AS s, end_tx_num AS f FROM files_item
      WHERE start_tx_num < end_tx_num AND can_delete IS DISTINCT FROM true AND series IS NOT NULL
    ), m AS (
      SELECT *, max(f) OVER (PARTITION BY series ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r
    ), i AS (
      SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS island FROM m
    ), p AS (SELECT series, island, min(s) AS s, max(f) AS f FROM i GROUP BY series, island)
    SELECT series, 'period' AS kind, s AS start_tx_num, f AS end_tx_num FROM p
    UNION ALL
    SELECT series, 'gap', f, n FROM (SELECT series, f, lead(s) OVER (PARTITION BY series ORDER BY s) AS n FROM p) WHERE n IS NOT NULL
    """,
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files_item").where(~F.coalesce("can_delete", F.lit(False)))
    return periods_and_gaps(files, entity="series", start="start_tx_num", end="end_tx_num")


_P4 = """
    WITH s AS (SELECT tx_num, bool_or(complete) AS complete FROM snapshot_runs GROUP BY tx_num),
    d AS (
      SELECT lower(address) AS address, a.tx_num, nonce, balance, code_hash FROM account_snapshots a JOIN s USING (tx_num)
      WHERE address IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY lower(address), a.tx_num ORDER BY row_id DESC) = 1
    ), c AS (SELECT x.tx_num, min(y.tx_num) AS nc FROM s x JOIN s y ON y.tx_num > x.tx_num AND y.complete GROUP BY x.tx_num),
    n AS (
      SELECT d.*, c.nc, lag(d.tx_num) OVER o AS pt, lag(c.nc) OVER o AS pnc, lag(nonce) OVER o AS pn, lag(balance) OVER o AS pb, lag(code_hash) OVER o AS pc,
        lead(d.tx_num) OVER o AS nt, lead(nonce) OVER o AS nn, lead(balance) OVER o AS nb, lead(code_hash) OVER o AS nco
      FROM d LEFT JOIN c USING (tx_num) WINDOW o AS (PARTITION BY address ORDER BY d.tx_num)
    ), e AS (
      SELECT address, tx_num, nonce, balance, code_hash,
        pt IS NULL OR coalesce(pnc < tx_num, false) OR nonce IS DISTINCT FROM pn OR balance IS DISTINCT FROM pb OR code_hash IS DISTINCT FROM pc AS starts,
        CASE WHEN nc IS NOT NULL AND (nt IS NULL OR nc < nt) THEN nc
             WHEN nt IS NOT NULL AND (nonce IS DISTINCT FROM nn OR balance IS DISTINCT FROM nb OR code_hash IS DISTINCT FROM nco) THEN nt END AS ends
      FROM n
    ), f AS (SELECT *, min(ends) OVER (PARTITION BY address ORDER BY tx_num ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS until FROM e)
    SELECT address, tx_num AS valid_from, coalesce(until, -1) AS valid_to {more} FROM f WHERE starts
    """


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_from_snapshots(
        table(spark, sf_dir, "account_snapshots"), table(spark, sf_dir, "snapshot_runs"), key=F.lower("address"), at="tx_num", tie="row_id", values=["nonce", "balance", "code_hash"]
    ).withColumnRenamed("key", "address")


@core.query("p4_found", _P4.format(more=""))
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("address", "valid_from", "valid_to")


@core.query("p4_versions", _P4.format(more=", nonce, CAST(balance AS VARCHAR) AS balance, code_hash"))
def p4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).withColumn("balance", F.col("balance").cast("string"))


@core.query("p4_appended", _P4.format(more=", nonce, CAST(balance AS VARCHAR) AS balance, code_hash"))
def p4_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same versions as p4_versions, from a history to which the snapshots were appended one after another."""
    runs = table(spark, sf_dir, "snapshot_runs").where("tx_num is not null").groupBy("tx_num").agg(F.max(F.coalesce("complete", F.lit(False))).alias("complete"))
    rows = table(spark, sf_dir, "account_snapshots").select(F.lower("address").alias("address"), "tx_num", "row_id", "nonce", "balance", "code_hash")
    at = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    rows.where("tx_num is not null").write.partitionBy("tx_num").parquet(f"{at}/snapshots")  # as they would lie when each comes by itself
    snapshots = spark.read.schema(rows.schema).parquet(f"{at}/snapshots")
    history = SnapshotHistory(spark, f"{at}/history", key="address", values=["nonce", "balance", "code_hash"], tie="row_id")
    for run in runs.orderBy("tx_num").toLocalIterator():
        history.append(snapshots.where(F.col("tx_num") == run["tx_num"]), run["tx_num"], run["complete"])
    return history.versions().withColumnRenamed("key", "address").withColumn("balance", F.col("balance").cast("string"))


@core.query(
    "p5_found",
    "SELECT k, count(DISTINCT tx_num) AS n_tx, min(tx_num) AS first_tx, max(tx_num) AS last_tx FROM change_log WHERE k IS NOT NULL GROUP BY k",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_entries(table(spark, sf_dir, "change_log"), key="k", time="tx_num")


@core.query(
    "p6_found",
    """
    SELECT arrival_id FROM pool_txs WHERE id_hash IS NOT NULL
    QUALIFY arrival_id > min(arrival_id) OVER (PARTITION BY id_hash)
    """,
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_before(table(spark, sf_dir, "pool_txs"), key="id_hash", order="arrival_id").where("repeat").select("arrival_id")


@core.query("p6_wrong_answers")
def p6_wrong_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals, true repeats, wrong answers of the filters and their share. A filter errs on the side of "seen", but for keys
    with very many rows: they are spread over several filters, and ``missed`` counts the repeats called new there."""
    return audit(seen_before(table(spark, sf_dir, "pool_txs"), key="id_hash", order="arrival_id"))


@core.query(
    "p6_repeats",
    "SELECT count(*) AS arrivals, count(*) FILTER (WHERE again) AS repeats FROM (SELECT arrival_id > min(arrival_id) OVER (PARTITION BY id_hash) AS again FROM pool_txs WHERE id_hash IS NOT NULL)",
)
def p6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p6_wrong_answers says of the arrivals themselves."""
    return p6_wrong_answers(spark, sf_dir).select("arrivals", "repeats")


@core.query(
    "p6_forget",
    """
    WITH f AS (SELECT DISTINCT id_hash FROM pool_txs WHERE arrival_id % 2 = 0 AND id_hash IS NOT NULL),
    g AS (SELECT id_hash FROM f WHERE id_hash NOT IN (SELECT id_hash FROM pool_txs WHERE block_added IS NOT NULL AND id_hash IS NOT NULL))
    SELECT arrival_id FROM pool_txs WHERE arrival_id % 2 = 1 AND id_hash IN (SELECT id_hash FROM g)
    """,
)
def p6_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters kept over three runs: keys of every second arrival are added, those of mined transactions taken out, and the
    other arrivals asked. Keys that the filters call seen are checked against the keys that were left in."""
    txs = table(spark, sf_dir, "pool_txs").select("arrival_id", "id_hash", "block_added")
    first, second = txs.where("arrival_id % 2 = 0 and id_hash is not null"), txs.where("arrival_id % 2 = 1")
    mined = first.select("id_hash").join(txs.where("block_added is not null").select("id_hash"), "id_hash", "left_semi")
    kept = materialize(update_filters(None, first, key="id_hash"), "filters")
    kept = materialize(update_filters(kept, mined, key="id_hash", remove=True), "filters")
    maybe = ask_filters(kept, second, key="id_hash")
    known = first.select("id_hash").join(mined, "id_hash", "left_anti")
    return maybe.join(known, "id_hash", "left_semi").select("arrival_id")
