"""Heavy keys found from a sample of the scan; what depends on them doesn't depend on the sample."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chronolake.operators.ordered import global_rank, running
from chronolake.operators.salted import index_entries
from chronolake.plans import skew


@pytest.fixture(scope="module")
def lopsided(spark):
    """400,000 rows of which one key has a third; another third are one pair of key and time."""
    k = F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 3 == 1, -2).otherwise(F.col("id"))
    t = F.when(F.col("id") % 3 == 1, 5).otherwise(F.xxhash64("id") % 1_000_000)
    return spark.range(0, 400_000, 1, 16).select(k.alias("k"), t.alias("t"), F.col("id").alias("v"))


def test_heavy_keys(spark, lopsided):
    heavy, total = skew.heavy_keys(lopsided, "k")
    assert set(heavy) == {-1, -2} and all(abs(n - 133_333) < 20_000 for n in heavy.values()) and abs(total - 400_000) < 40_000
    assert skew.heavy_keys(lopsided.where("k >= 0"), "k")[0] == {}
    assert skew.heavy_keys(lopsided.withColumn("k", F.lit(None).cast("long")), "k")[0] == {}
    assert skew.heavy_keys(lopsided.limit(0), "k", 5) == ({}, 0.0)
    found = skew.time_bounds(lopsided, "k", "t").frame.where("k = -1").first()
    assert len(found["__bounds"]) > 20 and found["__starts"][-1] == found["__last"] == len(found["__bounds"])


def test_the_threshold_has_an_upper_bound():
    assert skew.task_rows(10**12) == skew.MAX_ROWS and skew.task_rows(10) == skew.MIN_ROWS


def test_small_frames_are_not_read(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for f in (tmp_path / "t").glob("*.parquet"):
        f.unlink()
    assert skew.time_bounds(df, "id", "id") is None


def test_a_part_of_the_pieces_is_read(spark):
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(0, 400_000, 1, 40).select((F.col("id") % 7).alias("k")).mapInArrow(touch, "k long")
    heavy, total = skew.heavy_keys(df, "k")
    assert len(heavy) == 7 and seen.value == 40_000 and total == 400_000


def test_shards_cut_equal_times_by_their_ties(spark, lopsided):
    x, sharded = skew.with_shards(lopsided, ["k"], ["t", "v"])
    n = x.where("k = -2").groupBy("__shard").count().agg(F.max("count")).first()[0]
    assert sharded and n < 30_000  # of 133,333, in 16 pieces of which two are read


def test_ranks_over_a_whole_table(spark, lopsided):
    r = global_rank(lopsided.where("k = -1"), order="t", ties=["v"])
    bad = r.join(lopsided.where("k = -1").selectExpr("v", "row_number() over (order by t, v) - 1 as want"), "v").where("rank <> want")
    assert bad.count() == 0 and r.count() == 133_334
    s = running(lopsided, keys=["k"], time="t", ties=["v"], sums={"s": "v"}).where("k = -2").agg(F.max("s"), F.max("rank")).first()
    assert tuple(s) == (sum(range(1, 400_000, 3)), 133_333)


def test_index_entries_of_heavy_keys(spark, lopsided):
    want = lopsided.groupBy("k").agg(F.count_distinct("t").alias("n_tx"), F.min("t").alias("a"), F.max("t").alias("z")).where("k < 0")
    assert rows(index_entries(lopsided, key="k", time="t").where("k < 0")) == rows(want)


@pytest.mark.parametrize("kind", ["int", "tinyint", "double", "timestamp", "date", "string", "decimal(20,2)"])
def test_times_of_any_type_in_order(spark, kind):
    """Tables in order of time, read in part: every shard has its rows, whatever the type and however close to its end."""
    t = {"timestamp": "timestamp_micros(id * 600000000000)", "date": "date_add(date'9990-01-01', cast(id / 200 as int))", "tinyint": "cast(id / 4000 as tinyint)", "int": "cast(id + 2147000000 as int)"}.get(kind, f"cast(id as {kind})")
    df = spark.range(0, 400_000, 1, 40).selectExpr("1 as k", f"{t} as t", "id as v")
    found = skew.time_bounds(df, "k", "t", 20_000)
    bounds = found.frame.first()["__bounds"]
    assert bounds == sorted(bounds) and len(bounds) > 5
    r = global_rank(df, order="t", ties=["v"], hot_rows=20_000).agg(F.sum("rank"), F.max("rank"), F.count_distinct("rank")).first()
    assert tuple(r) == (399_999 * 400_000 // 2, 399_999, 400_000)
