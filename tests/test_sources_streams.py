"""Stores, pages, file names and streams."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chronolake.sources import files
from chronolake.sources.pages import register
from chronolake.sources.store import VersionedTable
from chronolake.streaming.state_changes import SCHEMA, StateTable, effective, latest_per_key


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(LookupError):
        t.view()
    assert t.commit(spark.createDataFrame([(1, "a")], "k long, v string")) == 1
    first = t.view()
    assert t.update(lambda df: df.union(spark.createDataFrame([(2, "b")], "k long, v string"))) == 2
    assert rows(first) == [(1, "a")] and rows(t.view()) == [(1, "a"), (2, "b")] and rows(t.view(1)) == [(1, "a")]
    with pytest.raises(Exception, match="boom"):
        t.update(lambda df: df.withColumn("k", F.raise_error(F.lit("boom")).cast("long")))
    assert t.versions() == [1, 2]
    t.remove_before(2)
    assert t.versions() == [2]


def test_pages(spark, tmp_path):
    for chain in ("a", "b"):
        (tmp_path / chain).mkdir()
        (tmp_path / chain / "first.json").write_text(json.dumps({"pairs": [[1, chain]], "next": "p2"}))
        (tmp_path / chain / "p2.json").write_text(json.dumps({"pairs": [[2, chain], [3, None]]}))
    register(spark)
    assert rows(spark.read.format("pages").load(str(tmp_path)).where("k < 3")) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]


def test_file_names(spark):
    df = spark.createDataFrame([("v1-a-b.10-20.kv",), ("v1-a.-1-3.kv",), ("",), (None,)], "name string")
    got = files.listing(df, "name")
    assert rows(got) == [("v1-a-b.10-20.kv", 1, "a-b", 10, 20, "kv")]
    assert rows(got.select(files.format_name(F.col("version"), F.col("entity"), F.col("start_step"), F.col("end_step"), F.col("ext")))) == [("v1-a-b.10-20.kv",)]


CHANGES = [(1, "FORWARD", 1, 10, 1.0), (2, "FORWARD", 2, 11, 2.0), (3, "FORWARD", 1, 12, 3.0), (4, "UNWIND", None, 11, None), (5, "FORWARD", 2, 11, 5.0), (6, "UNWIND", None, 12, None), (7, "FORWARD", 1, 13, None)]


def test_rollbacks(spark):
    assert rows(effective(spark.createDataFrame(CHANGES, SCHEMA))) == [(1, 10, 1.0), (1, 13, None), (2, 11, 5.0)]
    assert effective(spark.createDataFrame([], SCHEMA)).count() == 0


def test_state_table_counts_a_batch_once(spark, tmp_path):
    src = str(tmp_path / "src")
    for i in range(0, 7, 2):
        spark.createDataFrame(CHANGES[i : i + 2], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    t = StateTable(spark, str(tmp_path / "table"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    t.follow(stream, str(tmp_path / "cp")).awaitTermination()
    assert rows(t.state()) == [(2, 5.0)]
    t.apply(spark.read.parquet(src).where("seq <= 2"), 0)
    assert rows(t.state()) == [(2, 5.0)]
    t.follow(stream, str(tmp_path / "cp")).awaitTermination()
    assert t.changes().count() == 7


def test_keyed_state(spark, tmp_path):
    src = str(tmp_path / "src")
    data = [(1, "FORWARD", 1, 10, 1.0), (2, "FORWARD", 1, 12, 3.0), (3, "UNWIND", 1, 11, None), (4, "FORWARD", 2, 5, 9.0), (5, "UNWIND", 2, 1, None)]
    for row in data:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    q = latest_per_key(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.outputMode("update").format("memory").queryName("keyed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("keyed")) == [(1, 10, 1.0), (2, None, None)]
