"""Priority pools over streams of entries: slots, running conditions, capacity, greedy selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolake.operators.ordered import global_rank, running
from chronolake.sources.store import VersionedTable


def unknown(arrivals: DataFrame, *known: DataFrame, key: str) -> DataFrame:
    """Different keys of the arrivals that none of the known frames has; NULL keys are left out."""
    seen = known[0].select(key)
    for k in known[1:]:
        seen = seen.union(k.select(key))
    return arrivals.select(key).where(F.col(key).isNotNull()).distinct().join(seen, key, "left_anti")


def per_slot(entries: DataFrame, slot: Sequence[str], better: Sequence[str]) -> DataFrame:
    """The one entry of each slot that is greatest by ``better``; copies are reduced before the shuffle."""
    rest = [c for c in entries.columns if c not in (*slot, *better)]
    best = entries.groupBy(*slot).agg(F.max(F.struct(*better, *rest)).alias("x"))
    return best.select(*slot, *[F.col(f"x.{c}").alias(c) for c in entries.columns if c not in slot])


def without_done(entries: DataFrame, done: DataFrame, owner: str, number: str) -> DataFrame:
    """Entries without those whose number isn't above the greatest done number of their owner."""
    most = done.groupBy(owner).agg(F.max(number).alias("__done"))
    return entries.join(most, owner, "left").where(F.col("__done").isNull() | (F.col(number) > F.col("__done"))).drop("__done")


def running_conditions(entries: DataFrame, *, owner: str, number: str, base: str, sums: dict[str, str], mins: dict[str, str]) -> DataFrame:
    """Each entry with running sums and minima over its owner's entries in the order of their numbers, and ``no_gap``: whether
    the numbers follow each other without a gap from ``base`` (a column of the owner) on. Entries below ``base`` are dropped
    first. Numbers must be different within an owner."""
    live = entries.where(F.col(number) >= F.col(base))
    r = running(live, keys=[owner], time=number, sums=sums, mins=mins)
    return r.withColumn("no_gap", F.col(number) == F.col(base) + F.col("rank") - 1).drop("rank")


def keep_best(entries: DataFrame, pool: str, order: Sequence[Column], most: int) -> DataFrame:
    """The best ``most`` entries of each pool. Each task passes on at most ``most`` rows a pool, so the one task that ranks a
    pool never sees it whole. NULL pools are one pool."""
    ranked = entries.withColumn("__rn", F.row_number().over(W.partitionBy(pool).orderBy(*order)))
    return ranked.where(F.col("__rn") <= most).drop("__rn")


def drop_upper_half(entries: DataFrame, owner: str, number: str, tie: str) -> DataFrame:
    """Entries without, of each owner, the half (rounded down) with the highest numbers."""
    n = entries.groupBy(owner).agg(F.count(F.lit(1)).alias("__n"))
    r = running(entries, keys=[owner], time=number, ties=[tie])
    joined = r.join(n.withColumnRenamed(owner, "__o"), F.col(owner).eqNullSafe(F.col("__o")))
    return joined.where(F.col("rank") <= F.col("__n") - F.floor(F.col("__n") / 2)).drop("rank", "__n", "__o")


def dense_ids(entries: DataFrame, owner: str) -> DataFrame:
    """(``owner``, ``id``): consecutive numbers from 1 for different owners, in their order."""
    return global_rank(entries.select(owner).where(F.col(owner).isNotNull()).distinct(), order=owner, name="id", base=1)


def pick_greedily(
    entries: DataFrame, *, order: Sequence[str], cost: str | Sequence[str], budget: int | Sequence[int], most: int, skip: DataFrame | None = None, key: str | None = None, chunk: int = 10_000
) -> DataFrame:
    """Entries taken one by one in descending ``order`` (whole numbers, unique together) while each of their costs fits into
    what is left of its budget, at most ``most``; an entry that doesn't fit costs nothing. The first cost must be positive,
    the others at least 0. Entries whose ``key`` is in ``skip`` are left out, those with a NULL key aren't.

    What one entry leaves decides on the next, so no sums over a window tell it. Chunks of the best entries that still fit
    are read one after another; each chunk starts behind the last and costs above what is left aren't read. There are at
    most first budget / smallest first cost entries to take.
    """
    costs, budgets = ([cost], [budget]) if isinstance(cost, str) else (list(cost), list(budget))
    if len(costs) != len(budgets) or (skip is None) != (key is None):
        raise ValueError("each cost needs a budget, and skip a key")
    spark, schema = entries.sparkSession, entries.schema
    if skip is not None:
        entries = entries.join(skip.select(key), key, "left_anti").select(*entries.columns)
    taken, left, after = [], budgets, None
    while len(taken) < most and left[0] > 0:
        rest = entries.where(F.col(costs[0]) > 0)
        for i, c in enumerate(costs):
            rest = rest.where((F.col(c) <= left[i]) & (F.col(c) >= 0))
        if after is not None:
            behind, equal = F.lit(False), F.lit(True)
            for c, x in zip(order, after):
                behind, equal = behind | (equal & (F.col(c) < F.lit(x))), equal & (F.col(c) == F.lit(x))
            rest = rest.where(behind)
        rows = rest.orderBy(*[F.desc(c) for c in order]).limit(chunk).collect()
        if not rows:
            break
        for row in rows:
            after = tuple(row[c] for c in order)
            if all(row[c] <= x for c, x in zip(costs, left)):
                taken.append(row)
                left = [x - row[c] for c, x in zip(costs, left)]
                if len(taken) == most:
                    break
    return spark.createDataFrame(taken, schema)


def reasons(asked: DataFrame, known: DataFrame, key: str, default: str) -> DataFrame:
    """(``key``, ``reason``): the recorded reason of each different key asked for, or the default. One reason a key."""
    return asked.select(key).where(F.col(key).isNotNull()).distinct().join(known.groupBy(key).agg(F.max("reason").alias("reason")), key, "left").select(key, F.coalesce("reason", F.lit(default)).alias("reason"))


def saturating(x: Column, top: str = "99999999999999999999999999999999999999") -> Column:
    """A decimal that keeps its greatest value instead of overflowing (give it a try_ expression)."""
    return F.coalesce(x, F.lit(top).cast("decimal(38,0)"))


def add(entries: DataFrame, arrivals: DataFrame, *, key: str, slot: Sequence[str], better: Sequence[str]) -> DataFrame:
    """The pool after arrivals: those of known keys are ignored, of several for one slot the best stays."""
    new = arrivals.where(F.col(key).isNotNull()).join(entries.select(key), key, "left_anti").select(*entries.columns)
    return per_slot(entries.unionByName(new), slot, better).select(*entries.columns)


def classify(entries: DataFrame, *, fee: str, base_fee: int, order: Sequence[Column], limits: dict[str, int], no_gap: str = "no_gap", covered: str = "covered") -> DataFrame:
    """Entries with ``pool``: pending if their owner's numbers have no gap, the balance covers them and they pay the base fee,
    base_fee if only that is missing, otherwise queued. Of each pool the best ``limits`` stay; others are dropped. NULL
    conditions don't hold."""
    ready = F.coalesce(F.col(no_gap) & F.col(covered), F.lit(False))
    pays = F.coalesce(F.col(fee) >= base_fee, F.lit(False))
    pool = F.when(ready & pays, "pending").when(ready, "base_fee").otherwise("queued")
    most = F.coalesce(*[F.when(F.col("pool") == p, n) for p, n in limits.items()])
    ranked = entries.withColumn("pool", pool).withColumn("__rn", F.row_number().over(W.partitionBy("pool").orderBy(*order)))
    return ranked.where(F.col("__rn") <= max(limits.values())).where(F.col("__rn") <= most).drop("__rn")


def after_block(entries: DataFrame, mined: DataFrame, unwound: DataFrame, *, key: str, owner: str, number: str, slot: Sequence[str], better: Sequence[str]) -> DataFrame:
    """The pool after a block: entries that a block took back are in again, those up to the greatest mined number of their owner
    are gone, one stays a slot."""
    return without_done(add(entries, unwound, key=key, slot=slot, better=better), mined, owner, number)


def status(entries: DataFrame) -> DataFrame:
    """(``pool``, ``n``): how many entries each pool has."""
    return entries.groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


class PoolStore:
    """A pool that is kept: each flush is a version that holds the entries and the last block they have seen."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path)

    def flush(self, entries: DataFrame, last_block: int) -> int:
        return self.table.commit(entries, note={"last_block": last_block})

    def load(self) -> tuple[DataFrame, int]:
        """The entries and the last block."""
        return self.table.view(), self.table.note()["last_block"]
