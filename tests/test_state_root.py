"""The state root query on a small fixture."""

from decimal import Decimal

from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronolake.functions import codec
from chronolake.operators import commitment

A, B, C, D, E = ("0x" + x * 20 for x in ("aa", "bb", "cc", "dd", "ee"))


def test_root_is_of_the_last_snapshot(spark, tmp_path):
    runs = [(1, 10, True), (2, 20, True), (3, 30, False), (4, 40, None)]
    accounts = [
        (1, A, 10, 1, 5), (2, B, 10, 1, 6), (3, C, 10, 1, 7), (4, D, 10, 1, 8),  # D isn't in the complete snapshot at 20
        (5, A, 20, 2, 50), (6, B, 20, 2, 60), (7, C, 20, 2, 70), (8, A.upper().replace("X", "x"), 20, 3, 51),
        (9, C, 30, 3, None), (10, B, 30, 4, 61), (11, E, 40, 1, 9), (12, D, 99, 1, 1), (13, None, 40, 1, 1),
    ]
    money = lambda x: None if x is None else Decimal(x)
    spark.createDataFrame(runs, "snap_no long, tx_num long, complete boolean").write.parquet(f"{tmp_path}/snapshot_runs.parquet")
    schema = "row_id long, address string, tx_num long, nonce long, balance decimal(38,0)"
    spark.createDataFrame([(*x[:4], money(x[4])) for x in accounts], schema).write.parquet(f"{tmp_path}/account_snapshots.parquet")
    want = spark.createDataFrame([(A, 3, "51"), (B, 4, "61"), (E, 1, "9")], "a string, nonce long, balance string")
    want = commitment.state_root(want.select(codec.hex_decode(F.col("a")).alias("k"), commitment.account_value("nonce", F.col("balance")).alias("v")))
    assert rows(entry.queries()["t1_state_root"](spark, str(tmp_path))) == rows(want)
