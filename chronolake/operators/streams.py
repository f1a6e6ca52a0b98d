"""Combinators of ordered streams: frames with one column ``v``, or with ``k`` and ``v``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _cut(df: DataFrame, by: str, asc: bool, limit: int) -> DataFrame:
    return df.orderBy(F.col(by).asc() if asc else F.col(by).desc()).limit(limit) if limit >= 0 else df


def literal(spark: SparkSession, values: Sequence[int], reverse: bool = False) -> DataFrame:
    """A stream of given numbers, with their position."""
    return spark.createDataFrame(list(enumerate(reversed(values) if reverse else values)), "pos int, v bigint")


def numbers(spark: SparkSession, start: int, end: int) -> DataFrame:
    """start <= v < end; equal bounds give that one number."""
    return spark.range(start, end if end != start else end + 1).select(F.col("id").alias("v"))


def union(x: DataFrame, y: DataFrame, *, asc: bool = True, limit: int = -1) -> DataFrame:
    """Different values of both streams; the limit holds also if one is empty."""
    return _cut(x.select("v").union(y.select("v")).distinct(), "v", asc, limit)


def union_pairs(x: DataFrame, y: DataFrame, limit: int = -1) -> DataFrame:
    """Pairs of both streams; for a key in both those of ``x``."""
    return _cut(x.select("k", "v").unionByName(y.select("k", "v").join(x, "k", "left_anti")), "k", True, limit)


def intersect(x: DataFrame, y: DataFrame, limit: int = -1) -> DataFrame:
    """Different values that both streams have."""
    return _cut(x.select("v").distinct().join(y, "v", "left_semi"), "v", True, limit)


def page(df: DataFrame, by: str, after=None, size: int = 16384) -> DataFrame:
    """The next page after a token: keyset paging, so no earlier page is read again."""
    return (df if after is None else df.where(F.col(by) > after)).orderBy(by).limit(size)


def pages(df: DataFrame, by: str, size: int) -> Iterator[DataFrame]:
    """All pages; ``by`` must be unique. The token of the next page is the last key of this one."""
    after = None
    while True:
        part = page(df, by, after, size)
        last = part.agg(F.max(by)).first()[0]
        if last is None:
            return
        yield part
        after = last


def transform(df: DataFrame, **columns: Column) -> DataFrame:
    """The pairs with new expressions for some columns."""
    return df.withColumns(columns)


def failing(df: DataFrame, at: int, order: str) -> DataFrame:
    """Fault injection: the frame raises an error when the row with ``order == at`` is read."""
    return df.withColumn(order, F.when(F.col(order) == at, F.raise_error(F.lit("expected error at iteration"))).otherwise(F.col(order)).cast(df.schema[order].dataType))


def same(x: DataFrame, y: DataFrame) -> bool:
    """Whether both frames have the same rows, each as often."""
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def consume(df: DataFrame, walker: Callable) -> None:
    """Calls ``walker`` with an iterator of the rows of each partition, on the executors."""
    df.foreachPartition(walker)
