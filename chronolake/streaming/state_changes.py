"""Streams of state changes with rollbacks, by micro-batches and by keyed state."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronolake.operators.asof import as_known_at
from chronolake.operators.ordered import running
from chronolake.operators.temporal import latest

#: A change: its number in the stream, its direction, key, time and value; a rollback has only number, direction and time.
SCHEMA = "seq bigint, direction string, k bigint, tx bigint, v double"


def effective(changes: DataFrame) -> DataFrame:
    """(``k``, ``tx``, ``v``): forward changes that no later rollback took back. A rollback to ``tx`` takes back every change
    at or after that time that came before it in the stream.

    A change is taken back if the smallest time of the rollbacks after it isn't above its own, which is one running minimum
    over the rollbacks and one as-of lookup; rollbacks are few and never joined with all changes.
    """
    back = changes.where("direction = 'UNWIND'").withColumn("__rev", -F.col("seq"))
    back = running(back, keys=[], time="__rev", mins={"__to": "tx"}).select(F.lit(0).alias("__one"), "__rev", "__to")
    ahead = changes.where("direction = 'FORWARD'").withColumn("__one", F.lit(0)).withColumn("__when", -F.col("seq"))
    # rollbacks after seq are those with a smaller __rev; the last of them holds the minimum over all of them
    found = as_known_at(ahead, back, key="__one", event_time="__when", order=["__rev"], available=["__rev"], payload=["__to"], how="left")
    return found.where(F.col("__to").isNull() | (F.col("tx") < F.col("__to"))).select("k", "tx", "v")


class StateTable:
    """The changes of a stream, appended batch by batch; the state follows from them. A batch that is run again replaces
    itself, so each counts once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def changes(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def state(self) -> DataFrame:
        return latest(effective(self.changes()))

    def follow(self, stream: DataFrame, checkpoint: str, **trigger):
        """Starts a query that appends each micro-batch."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_per_key(stream: DataFrame, *, reach: int | None = None):
    """A stream of (``k``, ``tx``, ``v``): the state of each key after every micro-batch that touched it, v NULL if it has none.

    Rollbacks must carry the key they concern. State is all changes of a key that hold, one a time, so a rollback may reach
    back any way. With ``reach`` no rollback goes to a time more than that below the greatest time of its key so far; changes
    before that, but for the last of them, are dropped. A rollback that would need a dropped change is an error.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, top, dropped = state.get if state.exists else ([], [], None, None)
        kept = dict(zip(times, values))
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            tx = int(row.tx)
            if row.direction == "UNWIND":
                kept = {t: v for t, v in kept.items() if t < tx}
                if dropped is not None and max(kept, default=dropped) <= dropped:
                    raise ValueError(f"the rollback of key {key[0]} to {tx} reaches behind the changes kept")
            else:
                kept[tx] = None if pd.isna(row.v) else float(row.v)
                top = tx if top is None else max(top, tx)
        times = sorted(kept)
        if reach is not None and times:
            first = max(0, bisect_left(times, top - reach) - 1)
            if first:
                dropped = max(times[first - 1], times[first - 1] if dropped is None else dropped)
            times = times[first:]
        state.update((times, [kept[t] for t in times], top, dropped))
        tx, v = (times[-1], kept[times[-1]]) if times else (None, None)
        yield pd.DataFrame({"k": [key[0]], "tx": pd.array([tx], "Int64"), "v": [v]})

    return stream.groupBy("k").applyInPandasWithState(step, "k bigint, tx bigint, v double", "times array<bigint>, vs array<double>, top bigint, dropped bigint", "update", GroupStateTimeout.NoTimeout)
