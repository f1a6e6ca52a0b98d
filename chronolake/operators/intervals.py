"""Overlapping and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolake.plans.skew import first_shard, time_bounds


def periods_and_gaps(df: DataFrame, *, entity: str, start: str, end: str, hot_rows: int | None = None) -> DataFrame:
    """(``entity``, ``kind``, ``start``, ``end``): per entity the half-open periods covered and the gaps between them.

    Ranges are sorted by start and compared with the running maximum of the ends before; one that begins beyond it opens
    an island. Entities with very many ranges are sharded by start: a shard gets the maximum end and the last island label
    of the shards before it, so no task sorts a whole heavy entity.

    Ranges that touch are one period. Left out: a NULL entity, start or end, and ranges with start >= end. Repeated rows
    change nothing. An empty input gives an empty result; other columns are ignored.
    """
    valid = F.col(entity).isNotNull() & (F.col(start) < F.col(end))
    r = df.where(valid).select(F.col(entity).alias("__e"), F.col(start).alias("__s"), F.col(end).alias("__f"))
    bounds = time_bounds(r.select("__e", "__s"), "__e", "__s", hot_rows)
    r = r.groupBy("__e", "__s").agg(F.max("__f").alias("__f"))  # copies are reduced where they are
    if bounds is None:
        r = r.withColumn("__shard", F.lit(0)).withColumn("__carry", F.lit(None).cast(r.schema["__f"].dataType)).withColumn("__hot", F.lit(False))
    else:
        r = r.join(F.broadcast(bounds.frame), "__e", "left").withColumn("__shard", first_shard(F.col("__s"))).withColumn("__hot", F.col("__last").isNotNull()).drop("__bounds", "__starts", "__last")
        earlier = W.partitionBy("__e").orderBy("__shard").rowsBetween(W.unboundedPreceding, -1)
        ends = r.where("__hot").groupBy("__e", "__shard").agg(F.max("__f").alias("__f"), F.max("__s").alias("__s"))
        # "__s" stays in use, so that this branch has the columns of the other one and both read one shuffle
        carry = ends.where("__s is not null").select("__e", "__shard", F.max("__f").over(earlier).alias("__carry"))  # one row a shard
        r = r.join(F.broadcast(carry), ["__e", "__shard"], "left")
    w = W.partitionBy("__e", "__shard").orderBy("__s")
    r = r.withColumn("__prev", F.greatest(F.max("__f").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("__carry")))
    r = r.withColumn("__opens", F.col("__prev").isNull() | (F.col("__s") > F.col("__prev")))
    r = r.withColumn("__label", F.max(F.when(F.col("__opens"), F.col("__s"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # rows of a shard that continue an island of an earlier one have no label of their own
    part = r.groupBy("__e", "__shard", "__label", "__hot").agg(F.max("__f").alias("__end"), F.min(F.when(F.col("__opens"), F.col("__prev"))).alias("__prev"))
    if bounds is None:
        period = part
    else:
        last = part.where("__hot").groupBy("__e", "__shard").agg(F.max("__label").alias("__label"))
        last = last.select("__e", "__shard", F.max("__label").over(earlier).alias("__carried"))
        part = part.join(F.broadcast(last), ["__e", "__shard"], "left").withColumn("__label", F.coalesce("__label", "__carried"))
        period = part.groupBy("__e", "__label").agg(F.max("__end").alias("__end"), F.min("__prev").alias("__prev"))
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("__label").alias("s"), F.col("__end").alias("f")),
        F.struct(F.lit("gap").alias("kind"), F.col("__prev").alias("s"), F.col("__label").alias("f")),
    )
    rows = period.select("__e", F.explode(both).alias("x")).where("x.s is not null")
    return rows.select(F.col("__e").alias(entity), F.col("x.kind").alias("kind"), F.col("x.s").alias(start), F.col("x.f").alias(end))
