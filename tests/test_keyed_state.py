"""Keyed state of streams under rollbacks that reach far back."""

import pytest

from chronolake.streaming.state_changes import SCHEMA, latest_per_key


@pytest.fixture
def keyed(spark, tmp_path):
    def run(name, data, **how):
        src = str(tmp_path / name)
        for row in data:
            spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        q = latest_per_key(stream, **how).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{src}-cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()]

    return run


MANY = [(i, "FORWARD", 1, i, float(i)) for i in range(1, 201)]


def test_rollback_behind_many_changes_of_a_key(keyed):
    assert keyed("far", [MANY, [(201, "UNWIND", 1, 3, None)], [(202, "UNWIND", 1, 1, None)]]) == [(1, 200, 200.0), (1, 2, 2.0), (1, None, None)]


def test_rollback_behind_stated_reach(keyed):
    assert keyed("near", [MANY, [(201, "UNWIND", 1, 190, None)]], reach=10) == [(1, 200, 200.0), (1, 189, 189.0)]
    with pytest.raises(Exception, match="reaches behind"):
        keyed("behind", [MANY, [(201, "UNWIND", 1, 100, None)]], reach=10)
