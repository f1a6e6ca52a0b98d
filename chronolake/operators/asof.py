"""Attributes as known at event time: a bitemporal as-of join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolake.plans.skew import first_shard, spread_shard, time_bounds


def as_known_at(
    events: DataFrame,
    versions: DataFrame,
    *,
    key: str,
    event_time: str,
    order: Sequence[str],
    available: Sequence[str],
    payload: Sequence[str] = (),
    prefix: str = "",
    how: str = "inner",
    hot_rows: int | None = None,
) -> DataFrame:
    """Each event with the version of its key that was valid and known at the event's time.

    A version can be seen from the greatest of its ``available`` columns on; of those an event can see it gets the
    greatest by ``order`` (later columns break ties, then ``payload``). ``order`` and ``payload`` come out as columns with
    ``prefix``; a name that clashes with an event column must be given a prefix.

    Heavy keys are sharded by time. Each shard gets the best version of all earlier shards as its carry-in, so the
    running maximum inside a shard is already the answer. Many events at one time are spread over several shards.

    Nulls: versions with a NULL key or NULL in ``available`` are never seen; events with a NULL key or time match nothing.
    Repeated events come out as often as they come in. Empty inputs give an empty result (``how="left"``: the events).
    """
    names = list(dict.fromkeys([*order, *payload]))
    clash = {prefix + n for n in names} & set(events.columns)
    if clash:
        raise ValueError(f"columns clash, give a prefix: {sorted(clash)}")
    seen_from = F.greatest(*[F.col(c) for c in available]) if len(available) > 1 else F.col(available[0])
    known = F.col(key).isNotNull()
    for c in available:
        known = known & F.col(c).isNotNull()
    v = versions.where(known).select(F.col(key).alias("__k"), seen_from.alias("__t"), F.struct(*names).alias("__ver"))
    whole = F.col(key).isNotNull() & F.col(event_time).isNotNull()
    others = [c for c in events.columns if c not in (key, event_time)]  # key and time come back from what the rows are sorted by
    e = events.where(whole).select(F.col(key).alias("__k"), F.col(event_time).alias("__t"), F.struct(F.lit(1).alias("__is"), *others).alias("__ev"))
    bounds = time_bounds(v.select("__k", "__t").union(e.select("__k", "__t")), "__k", "__t", hot_rows)
    no_event, no_version = F.lit(None).cast(e.schema["__ev"].dataType), F.lit(None).cast(v.schema["__ver"].dataType)
    v = v.select("__k", "__t", F.lit(0).alias("__kind"), "__ver", no_event.alias("__ev"))
    rows = v.union(e.select("__k", "__t", F.lit(1).alias("__kind"), no_version.alias("__ver"), "__ev"))
    carry = None
    if bounds is None:
        rows = rows.withColumn("__shard", F.lit(0))
    else:
        # a version goes to the first shard of its time, events of one time to all shards of it
        rows = rows.join(F.broadcast(bounds.frame), "__k", "left")
        salt = F.when(F.col("__kind") == 1, F.xxhash64("__ev"))
        at = F.when(F.col("__kind") == 0, first_shard(F.col("__t"))).otherwise(spread_shard(F.col("__t"), salt))
        rows = rows.select("__k", at.alias("__shard"), F.coalesce("__last", F.lit(0)).alias("__last"), "__t", "__kind", "__ver", "__ev")
        rows = rows.repartition("__k", "__shard")
        # Both readers of this shuffle take all of its columns, so it is made once: the whole row is compared behind "__ver",
        # and the condition can't be moved below the shuffle as it isn't deterministic.
        mine = F.when(F.monotonically_increasing_id() >= 0, (F.col("__last") > 0) & (F.col("__kind") == 0))
        best = rows.where(mine).groupBy("__k", "__shard").agg(F.max(F.struct("__ver", "__t", "__ev", "__last", "__kind")).alias("__x"))
        nxt = W.partitionBy("__k").orderBy("__shard")
        best = best.select("__k", "__shard", F.max("__x.__ver").over(nxt).alias("__carry"), F.coalesce(F.lead("__shard").over(nxt) , F.col("__x.__last") + 1).alias("__until"))
        # what is known after a shard is carried into every later one up to the next shard with versions
        carry = best.select("__k", F.explode(F.sequence(F.col("__shard") + 1, F.col("__until"))).alias("__shard"), "__carry")
    sofar = W.partitionBy("__k", "__shard").orderBy(F.col("__t").asc_nulls_first(), "__kind").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("__best", F.max("__ver").over(sofar)).where("__ev is not null")
    if carry is not None:
        found = found.join(F.broadcast(carry), ["__k", "__shard"], "left")
        found = found.withColumn("__best", F.when(F.col("__last") > 0, F.greatest("__best", "__carry")).otherwise(F.col("__best")))
    if how != "left":
        found = found.where("__best is not null")
    same = {key: "__k", event_time: "__t"}
    columns = [F.col(same[c]).cast(events.schema[c].dataType).alias(c) if c in same else F.col(f"__ev.`{c}`").alias(c) for c in events.columns]
    found = found.select(*columns, *[F.col(f"__best.`{n}`").alias(prefix + n) for n in names])
    if how == "left":
        lost = events.where(~F.coalesce(whole, F.lit(False)))
        found = found.union(lost.select(*events.columns, *[F.lit(None).cast(versions.schema[n].dataType) for n in names]))
    return found
