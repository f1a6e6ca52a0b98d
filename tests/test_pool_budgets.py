"""Greedy selection under several budgets and a set of skipped keys."""

import random
from decimal import Decimal

from conftest import rows

import __spark_entry__ as entry
from chronolake.operators import pool


def test_greedy_pick_under_two_budgets(spark):
    r = random.Random(1)
    data = [(i, r.randint(0, 20), r.randint(1, 40), r.choice([0, 0, 1, 2]), None if i % 9 == 0 else i % 70) for i in range(300)]
    gas, blobs, want = 300, 5, []
    for i, _, g, b, k in sorted(data, key=lambda d: (-d[1], -d[0])):
        if k not in (1, 2, 3, 40) and g <= gas and b <= blobs and len(want) < 40:
            want.append(i)
            gas, blobs = gas - g, blobs - b
    df = spark.createDataFrame(data, "id long, tip long, gas long, blobs long, k long")
    skip = spark.createDataFrame([(1,), (2,), (2,), (3,), (40,), (None,)], "k long")
    got = pool.pick_greedily(df, order=["tip", "id"], cost=["gas", "blobs"], budget=[300, 5], most=40, skip=skip, key="k", chunk=17)
    assert [x.id for x in got.collect()] == want and blobs == 0


def test_best_keeps_the_blob_budget(spark, tmp_path):
    schema = "arrival_id long, sender_id long, nonce long, gas long, tip decimal(38,0), blob_hashes array<binary>"
    data = [(i, i, 0, 21000, 100 - i, [b"x"] * n if n is not None else None) for i, n in enumerate([4, 3, 2, None, 1, 0])]
    spark.createDataFrame([(*x[:4], Decimal(x[4]), x[5]) for x in data], schema).write.parquet(f"{tmp_path}/pool_txs.parquet")
    got = entry.queries()["pool4_best"](spark, str(tmp_path))
    assert rows(got.select("arrival_id")) == [(0,), (2,), (3,), (5,)]
