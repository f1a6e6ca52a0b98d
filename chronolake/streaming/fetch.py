"""Transactions that arrive in packets, as a stream into a pool that is kept."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from chronolake.operators import pool


class Fetch:
    """Adds what a stream brings to a kept pool, micro-batch by micro-batch. Entries whose key the pool has are passed over, so a
    batch that is run again changes nothing; of several for one slot the best stays."""

    def __init__(self, store: pool.PoolStore, *, key: str, slot: Sequence[str], better: Sequence[str], read: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> None:
        self.store, self.key, self.slot, self.better, self.read = store, key, list(slot), list(better), read

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        new = self.read(batch)
        try:
            held, _ = self.store.load()
        except LookupError:
            held = new.limit(0)
        self.store.flush(pool.add(held, new, key=self.key, slot=self.slot, better=self.better), batch_id)

    def follow(self, stream: DataFrame, checkpoint: str, **trigger):
        """Starts a query that adds each micro-batch."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
