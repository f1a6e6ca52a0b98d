"""The filters' own wrong answers are all counted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.operators.cuckoo import CuckooFilter, audit, seen_before, update_filters


def test_wrong_answers_of_spread_keys_count(spark):
    df = spark.createDataFrame([(i, b"x" if i % 2 else i.to_bytes(4, "big")) for i in range(400)], "arrival_id long, id_hash binary")
    how = {"key": "id_hash", "order": "arrival_id", "hot_rows": 50}
    flags = seen_before(df, **how)
    filters = flags.where("arrival_id % 2 = 1 and not raw").count()
    got = audit(flags).first()
    assert filters > 1 and got.arrivals == 400 and got.repeats == 199
    first_was_new = flags.where("arrival_id = 1 and not raw").count()
    assert got.missed == filters - first_was_new > 0 and got.wrong_answers >= got.missed and got.share_wrong == got.wrong_answers / 400
    assert audit(seen_before(df, **how | {"hot_rows": 10**6})).first().missed == 0


@pytest.mark.parametrize("log2_buckets", [0, 2, 6, 9])
def test_hashes_at_once_are_answered_as_one_by_one(log2_buckets):
    rng = np.random.default_rng(log2_buckets)
    keys = rng.integers(0, 2**54, 1500, dtype=np.uint64)  # 64 different fingerprints: many keys look like others
    h = rng.permutation(np.r_[keys, rng.choice(keys, 500)])
    one, all_ = CuckooFilter(log2_buckets), CuckooFilter(log2_buckets)
    said = [bool(one.seen_then_add(h[i : i + 1])[0]) for i in range(len(h))]
    assert sum(said) > 510 and all_.seen_then_add(h).tolist() == said
    assert all_.has(h).all() and all_.seen_then_add(h[:0]).tolist() == []


def test_answers_come_from_the_filters_at_a_rate_that_holds_in_many_buckets(spark):
    df = spark.range(120_000).select(F.col("id").alias("arrival_id"), F.when(F.col("id") < 100_000, F.col("id")).otherwise(F.col("id") - 100_000).cast("string").alias("id_hash"))
    flags = seen_before(df, key="id_hash", order="arrival_id", bucket_rows=40, log2_buckets=3)
    assert flags.where("repeat != (arrival_id >= 100000)").count() == 0 and flags.where("repeat and not said").count() == 0
    got = audit(flags).first()
    assert (got.arrivals, got.repeats, got.missed) == (120_000, 20_000, 0)
    assert got.wrong_answers > 0 and got.false_positive_rate < 0.0005


def test_kept_filters_hold_keys_that_look_alike(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("id_hash"))
    kept = update_filters(None, keys, key="id_hash", bits=8, log2_buckets=0)
    states = [CuckooFilter.loads(r.state) for r in kept.collect()]
    assert sum(t.n for f in states for t in f.tables) == 3000
