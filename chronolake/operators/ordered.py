"""Neighbours and ranks in an order, without sorting a heavy key or a whole table in one task."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolake.plans.skew import with_shards


def _fresh(df: DataFrame, names: Iterable[str]) -> None:
    if clash := {*names} & {*df.columns}:
        raise ValueError(f"columns clash, rename them: {sorted(clash)}")


def _window(keys: Sequence[str], time: str, ties: Sequence[str]):
    return W.partitionBy(*keys, "__shard").orderBy(*[F.col(c).asc_nulls_first() for c in (time, *ties)])


def _with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with what ``carry`` holds for their key and shard: a row a shard of a heavy key, so it is broadcast."""
    on = [*keys, "__shard"]
    marked = F.broadcast(carry.select(*[F.col(c).alias(f"__e_{c}") if c in on else F.col(c) for c in carry.columns]))
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__e_{c}")) for c in on])
    return rows.join(marked, match, "left").drop(*[f"__e_{c}" for c in on])


def neighbour(
    df: DataFrame, *, keys: Sequence[str], time: str, ties: Sequence[str] = (), take: dict[str, str] | None = None, follow: dict[str, str] | None = None, hot_rows: int | None = None
) -> DataFrame:
    """``df`` with columns of the row before (``take``) and of the row after (``follow``) within ``keys``, in the order of
    ``time``, ``ties``.

    ``take``, ``follow``: name of the new column to the column taken; NULL for the first and the last row. Without ``keys``
    the whole table is one sequence. Heavy keys are sharded in that order; each shard gets the last row of the shard before
    it and the first of the one behind. NULL keys are a key of their own, NULL times come first; rows equal in ``time`` and
    ``ties`` are in no defined order.
    """
    take, follow = take or {}, follow or {}
    _fresh(df, [*take, *follow])
    rows, sharded = with_shards(df, keys, [time, *ties], hot_rows)
    w = _window(keys, time, ties)
    sides = [(s, names, F.struct(*[F.col(c).alias(n) for n, c in names.items()])) for s, names in (("__before", take), ("__behind", follow)) if names]
    for side, _, got in sides:
        rows = rows.withColumn(side, (F.lag if side == "__before" else F.lead)(got).over(w))
    if sharded:
        order = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in (time, *ties)])
        ends = [(F.max_by if side == "__before" else F.min_by)(got, order).alias(side) for side, _, got in sides]
        edges = rows.where("__hot").groupBy(*keys, "__shard").agg(*ends)
        by = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("__shard")
        carry = edges.select(*keys, "__shard", *[(F.lag if side == "__before" else F.lead)(side).over(by).alias(f"__c{side}") for side, _, _ in sides])
        rows = _with_carry(rows, carry, keys)
        for side, _, _ in sides:
            rows = rows.withColumn(side, F.coalesce(side, f"__c{side}"))
    return rows.select(*[F.col(c) for c in df.columns], *[F.col(f"{side}.{n}").alias(n) for side, names, _ in sides for n in names])


def running(
    df: DataFrame, *, keys: Sequence[str], time: str, ties: Sequence[str] = (), sums: dict[str, str] | None = None, mins: dict[str, str] | None = None, before: bool = False, hot_rows: int | None = None
) -> DataFrame:
    """``df`` with running sums, minima and ``rank`` (from 1) within ``keys`` in the order of ``time``, ``ties``.

    ``sums``/``mins``: name of the new column to its input. NULLs are skipped; a sum before the first value is NULL. With
    ``before`` sums and minima are those up to the row before. Heavy keys are sharded; totals of earlier shards are carried in.
    """
    sums, mins = sums or {}, mins or {}
    _fresh(df, [*sums, *mins, "rank"])
    rows, sharded = with_shards(df, keys, [time, *ties], hot_rows)
    upto = _window(keys, time, ties).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    parts = {n: (F.sum(c), lambda a, b: F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(a + b)) for n, c in sums.items()}
    parts |= {n: (F.min(c), F.least) for n, c in mins.items()}
    parts["rank"] = (F.count(F.lit(1)), lambda a, b: a + F.coalesce(b, F.lit(0)) + int(before))
    for n, (agg, _) in parts.items():
        rows = rows.withColumn(f"__r_{n}", agg.over(upto))
    if sharded:
        totals = rows.where("__hot").groupBy(*keys, "__shard").agg(*[agg.alias(f"__t_{n}") for n, (agg, _) in parts.items()])
        by = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("__shard").rowsBetween(W.unboundedPreceding, -1)
        carried = [(F.min if n in mins else F.sum)(f"__t_{n}").over(by).alias(f"__c_{n}") for n in parts]
        rows = _with_carry(rows, totals.select(*keys, "__shard", *carried), keys)
    for n, (_, join) in parts.items():
        rows = rows.withColumn(f"__r_{n}", join(F.col(f"__r_{n}"), F.col(f"__c_{n}") if sharded else F.lit(None)))
    return rows.select(*[F.col(c) for c in df.columns], *[F.col(f"__r_{n}").alias(n) for n in parts])


def global_rank(df: DataFrame, *, order: str, ties: Sequence[str] = (), name: str = "rank", base: int = 0, hot_rows: int | None = None) -> DataFrame:
    """``df`` with consecutive numbers from ``base`` in the order of ``order``, ``ties`` over the whole table."""
    _fresh(df, [name])
    ranked = running(df, keys=[], time=order, ties=ties, hot_rows=hot_rows)
    return ranked.select(*[F.col(c) for c in df.columns], (F.col("rank") - 1 + base).alias(name))
