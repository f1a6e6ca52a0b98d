"""Inverted indexes and sets of numbers: (``name``, ``k``, ``tx``) rows, or arrays of numbers per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build(log: DataFrame, **dimensions: str) -> DataFrame:
    """One index of several dimensions: a row (``name``, ``k``, ``tx``) for each different value and time. The log is read
    once; NULL values aren't indexed."""
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("k")) for n, c in dimensions.items()])
    return log.select("tx", F.explode(parts).alias("x")).select("x.name", "x.k", "tx").where("k is not null").distinct()


def put(index: DataFrame, entries: DataFrame) -> DataFrame:
    """The index with more entries (``name``, ``k``, ``tx``); those it has, and entries with a NULL key or time, change nothing."""
    new = entries.where("name is not null and k is not null and tx is not null").select("name", F.col("k").cast("string").alias("k"), "tx").distinct()
    return index.select("name", "k", "tx").unionByName(new.join(index, ["name", "k", "tx"], "left_anti"))


def index_range(index: DataFrame, name: str, key, start=None, end=None, *, asc: bool = True, limit: int = -1) -> DataFrame:
    """Times of one entry: ascending in [start, end), descending in (end, start]; None is unbounded, limit -1 is none."""
    if start is not None and end is not None and ((start > end) if asc else (start < end)):
        raise ValueError("the bounds are in the wrong order")
    found = index.where((F.col("name") == name) & (F.col("k") == F.lit(key)))
    if start is not None:
        found = found.where((F.col("tx") >= start) if asc else (F.col("tx") <= start))
    if end is not None:
        found = found.where((F.col("tx") < end) if asc else (F.col("tx") > end))
    found = found.select("tx").distinct()
    return found.orderBy(F.col("tx").asc() if asc else F.col("tx").desc()).limit(limit) if limit >= 0 else found


def changed_keys(log: DataFrame, start: int, end: int) -> DataFrame:
    """Different keys with a time in [start, end)."""
    return log.where((F.col("tx") >= start) & (F.col("tx") < end)).select("k").distinct()


def all_of(*entries: DataFrame) -> DataFrame:
    """Times that every entry has."""
    return reduce(lambda a, b: a.join(b, "tx", "left_semi"), [e.select("tx").distinct() for e in entries])


def any_of(*entries: DataFrame) -> DataFrame:
    """Times that some entry has."""
    return reduce(lambda a, b: a.union(b), [e.select("tx") for e in entries]).distinct()


def locality(log: DataFrame, span: int) -> DataFrame:
    """(``k``, ``file``): in which files of ``span`` times a key occurs."""
    return log.select("k", F.floor(F.col("tx") / span).cast("bigint").alias("file")).distinct()


def first_two_from(located: DataFrame, start: int) -> DataFrame:
    """(``k``, ``first``, ``second``): a key's first two files from ``start`` on; keys without one are left out. Arrays hold
    a key's files, never its rows."""
    files = located.where(F.col("file") >= start).groupBy("k").agg(F.array_sort(F.collect_set("file")).alias("a"))
    return files.select("k", F.get("a", F.lit(0)).alias("first"), F.get("a", F.lit(1)).alias("second"))


# sets of numbers by key, cut into shards of a fixed width so that no array grows with the data


def to_shards(index: DataFrame, width: int = 4096) -> DataFrame:
    """(``k``, ``shard``, ``ids``): sorted different times, those of one range of ``width`` in one array."""
    return index.groupBy("k", F.floor(F.col("tx") / width).cast("bigint").alias("shard")).agg(F.array_sort(F.collect_set("tx")).alias("ids"))


def from_shards(shards: DataFrame) -> DataFrame:
    """(``k``, ``tx``) again."""
    return shards.select("k", F.explode("ids").alias("tx"))


def clipped(shards: DataFrame, start: int, end: int, width: int = 4096) -> DataFrame:
    """Shards with only the numbers in [start, end): others aren't read, those at the edges are cut."""
    inside = shards.where((F.col("shard") >= start // width) & (F.col("shard") <= (end - 1) // width))
    return inside.withColumn("ids", F.filter("ids", lambda x: (x >= start) & (x < end))).where(F.size("ids") > 0)


def seek_in(ids: Column, at) -> Column:
    """The first number of a sorted array that isn't below ``at``, NULL if none."""
    return F.array_min(F.filter(ids, lambda x: x >= at))


def chunk_by_size(shards: DataFrame, most: int) -> DataFrame:
    """(``k``, ``shard``, ``chunk``, ``ids``): arrays cut into pieces of at most ``most`` numbers."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("ids") - 1, F.lit(0)), F.lit(most))
    cut = shards.select("k", "shard", "ids", F.posexplode(starts).alias("chunk", "at"))
    return cut.select("k", "shard", "chunk", F.slice("ids", F.col("at") + 1, most).alias("ids"))
