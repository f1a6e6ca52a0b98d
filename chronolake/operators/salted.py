"""Per-key results although a few keys hold most records: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.plans.skew import MAX_ROWS, heavy_keys

LEAST_SALTS = 16


def add_salt(df: DataFrame, key: str, on: Column, *, salts: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """``df`` with ``__salt``: a number drawn by the hash of ``on`` for heavy keys, 0 for all others. There are ``salts``
    of them, by default as many as keep each below what a task should take.

    A hash stands for the random draw: a task that is run again draws the same salts, and equal values of ``on`` meet, so
    that distinct counts may be added up over salts.
    """
    hot, _ = heavy_keys(df, key, hot_rows)
    if not hot:
        return df.withColumn("__salt", F.lit(0))
    marks = [(k, salts or max(LEAST_SALTS, -(-int(n) // (hot_rows or MAX_ROWS)))) for k, n in hot.items()]
    marked = df.join(F.broadcast(df.sparkSession.createDataFrame(marks, f"__hk {df.schema[key].dataType.simpleString()}, __salts int")), F.col(key) == F.col("__hk"), "left")
    return marked.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(on), F.col("__salts")), F.lit(0)).cast("int")).drop("__hk", "__salts")


def index_entries(df: DataFrame, *, key: str, time: str, salts: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """(``key``, ``n_tx``, ``first_tx``, ``last_tx``): the number of different times of each key, the first and the last.

    Rows with a NULL key are left out. A NULL time isn't counted; a key with no other gets 0 and NULLs. Repeated rows
    count once. An empty input gives an empty result.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col(time).alias("__t"))
    once = add_salt(rows, "__k", F.col("__t"), salts=salts, hot_rows=hot_rows).distinct()
    partial = once.groupBy("__k", "__salt").agg(F.count("__t").alias("n"), F.min("__t").alias("a"), F.max("__t").alias("z"))
    merged = partial.groupBy("__k").agg(F.sum("n").alias("n_tx"), F.min("a").alias("first_tx"), F.max("z").alias("last_tx"))
    return merged.withColumnRenamed("__k", key)
