import pytest
from conftest import rows
from pyspark.sql import types as T

from chronolake.operators import pool
from chronolake.sources.catalog import Catalog


def test_catalogue(spark, tmp_path):
    schema = T.StructType().add("k", T.LongType()).add("v", T.StringType())
    c = Catalog(spark, str(tmp_path), {"a": schema, "old": schema}, deprecated=["old"])
    assert c.names() == [] and c.view("a").count() == 0
    c.create("a")
    c.create("a")
    c.write("a", spark.createDataFrame([("x", 1, 2)], "v string, k int, more int"))
    assert c.names() == ["a"] and rows(c.view("a")) == [(1, "x")] and c.view("a", 1).count() == 0
    c.clear("a")
    assert c.view("a").count() == 0
    with pytest.raises(PermissionError):
        c.drop("a")
    with pytest.raises(LookupError):
        c.view("b")
    c.create("old")
    c.drop("old")
    assert not c.exists("old")


def test_add_to_pool(spark):
    cols = "h string, who long, n long, tip long"
    p = spark.createDataFrame([("a", 1, 0, 5), ("b", 1, 1, 5)], cols)
    new = spark.createDataFrame([("a", 1, 0, 99), ("c", 1, 1, 7), ("d", 1, 1, 6), (None, 2, 0, 1), ("e", 2, 0, 1)], cols)
    assert rows(pool.add(p, new, key="h", slot=["who", "n"], better=["tip", "h"])) == [("a", 1, 0, 5), ("c", 1, 1, 7), ("e", 2, 0, 1)]
