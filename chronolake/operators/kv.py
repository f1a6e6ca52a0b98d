"""Ordered key-value tables: point access, cursors, range scans and writes.

A table is a frame with a key column ``k`` and a value column ``v``; with several values a key it is a set of pairs in the
order of ``k``, ``v``. Frames come out unordered unless a limit makes the order part of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.operators.asof import as_known_at
from chronolake.operators.ordered import global_rank, neighbour


def get(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Values of the given keys (a frame with ``k``); keys that the table lacks and NULL keys are left out."""
    return table.join(keys.select("k").distinct(), "k", "left_semi")


def has(table: DataFrame, keys: DataFrame) -> DataFrame:
    """(``k``, ``found``) for each different given key; a NULL key is never found."""
    there = table.select("k").distinct().withColumn("found", F.lit(True))
    return keys.select("k").distinct().join(there, "k", "left").select("k", F.coalesce("found", F.lit(False)).alias("found"))


def first_and_last(table: DataFrame) -> DataFrame:
    """(``which``, ``k``, ``v``): the first and the last entry; none of an empty table. NULL keys aren't entries."""
    pair = F.struct("k", "v")
    ends = table.where("k is not null").agg(F.min(pair).alias("first"), F.max(pair).alias("last"))
    rows = ends.select(F.explode(F.array(F.struct(F.lit("first").alias("which"), F.col("first").alias("e")), F.struct(F.lit("last").alias("which"), F.col("last").alias("e")))).alias("x"))
    return rows.where("x.e is not null").select("x.which", "x.e.k", "x.e.v")


def seek(table: DataFrame, probes: DataFrame) -> DataFrame:
    """(``probe``, ``k``): for each different probe (a frame with ``probe``, whole numbers) the smallest key not below it.

    A backward as-of join over the whole table as one key; large tables are cut into shards of the key's range."""
    t = table.where("k is not null").select(F.lit(0).alias("__one"), (-F.col("k")).alias("__at"), "k")
    p = probes.where("probe is not null").distinct().select(F.lit(0).alias("__one"), (-F.col("probe")).alias("__when"), "probe")
    return as_known_at(p, t, key="__one", event_time="__when", order=["__at", "k"], available=["__at"]).select("probe", "k")


def seek_both_range(table: DataFrame, probes: DataFrame) -> DataFrame:
    """(``k``, ``probe``, ``v``): for each different pair (k, probe) the smallest value of exactly that key not below it."""
    t = table.where("v is not null").select("k", (-F.col("v")).alias("__at"), "v")
    p = probes.select("k", "probe").distinct().withColumn("__when", -F.col("probe"))
    return as_known_at(p, t, key="k", event_time="__when", order=["__at", "v"], available=["__at"]).select("k", "probe", "v")


def seek_both_exact(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The given pairs that the table has."""
    return pairs.select("k", "v").distinct().join(table, ["k", "v"], "left_semi")


def cursor(table: DataFrame) -> DataFrame:
    """Each entry with its next and previous one: (``k``, ``v``, ``next_k``, ``next_v``, ``prev_k``, ``prev_v``)."""
    return neighbour(table.select("k", "v"), keys=[], time="k", ties=["v"], take={"prev_k": "k", "prev_v": "v"}, follow={"next_k": "k", "next_v": "v"})


def dup_cursor(table: DataFrame) -> DataFrame:
    """Each entry with the next and previous value of the same key."""
    return neighbour(table.select("k", "v"), keys=["k"], time="v", take={"prev_v": "v"}, follow={"next_v": "v"})


def dup_summary(table: DataFrame) -> DataFrame:
    """(``k``, ``first_v``, ``last_v``, ``n``) per key: first and last value and how many different ones."""
    once = table.select("k", "v").distinct()
    return once.groupBy("k").agg(F.min("v").alias("first_v"), F.max("v").alias("last_v"), F.count("v").alias("n"))


def table_size(table: DataFrame) -> DataFrame:
    """(``n``, ``bytes``): entries and the length of their keys and values as text."""
    width = F.octet_length(F.col("k").cast("string")) + F.coalesce(F.octet_length(F.col("v").cast("string")), F.lit(0))
    return table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).cast("bigint").alias("bytes"))


def sequence(table: DataFrame, order: str, base: int = 0) -> DataFrame:
    """``table`` with ``seq``: consecutive numbers from ``base``, as an allocator would hand them out in this order."""
    return global_rank(table, order=order, name="seq", base=base)


def _bounds(col: Column, low, high, asc: bool) -> Column:
    keep = F.lit(True)
    if low is not None:
        keep = keep & ((col >= low) if asc else (col <= low))
    if high is not None:
        keep = keep & ((col < high) if asc else (col > high))
    return keep


def key_range(table: DataFrame, start=None, end=None, *, asc: bool = True, limit: int = -1) -> DataFrame:
    """Entries with start <= k < end, descending start >= k > end; None is unbounded, limit -1 is none.

    A range whose bounds are both given and don't leave room is an error, as it is a caller's mistake.
    """
    if start is not None and end is not None and ((start >= end) if asc else (start <= end)):
        raise ValueError("empty range: the bounds are in the wrong order")
    found = table.where(F.col("k").isNotNull() & _bounds(F.col("k"), start, end, asc))
    return ordered(found, asc, limit) if limit >= 0 else found


def ordered(table: DataFrame, asc: bool = True, limit: int = -1) -> DataFrame:
    """Entries in order, at most ``limit``: with a limit Spark keeps that many rows a task and never sorts the whole."""
    by = [F.col(c).asc() if asc else F.col(c).desc() for c in ("k", "v")]
    return table.orderBy(*by).limit(limit) if limit >= 0 else table.orderBy(*by)


def dup_range(table: DataFrame, key, start=None, end=None, *, asc: bool = True, limit: int = -1) -> DataFrame:
    """Values of one key with start <= v < end (descending start >= v > end)."""
    found = table.where((F.col("k") == F.lit(key)) & F.col("v").isNotNull() & _bounds(F.col("v"), start, end, asc))
    return ordered(found, asc, limit) if limit >= 0 else found


def next_subtree(prefix: bytes) -> bytes | None:
    """The first key after all keys with this prefix; None if there is none (empty or all 0xff)."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def prefix_scan(table: DataFrame, prefix) -> DataFrame:
    """Entries whose key (text or binary) starts with ``prefix``."""
    return table.where(F.col("k").startswith(F.lit(prefix)))


def masked_prefix(table: DataFrame, start: bytes, bits: int) -> DataFrame:
    """Entries whose binary key agrees with ``start`` in the first ``bits`` bits; shorter keys don't."""
    whole, rest = divmod(bits, 8)
    keep = F.length("k") >= whole + (rest > 0)
    if whole:
        keep = keep & (F.substring("k", 1, whole) == F.lit(start[:whole]))
    if rest:
        byte = F.conv(F.hex(F.substring("k", whole + 1, 1)), 16, 10).cast("int")
        keep = keep & (F.shiftright(byte, 8 - rest) == (start[whole] >> (8 - rest)))
    return table.where(keep)


def put(table: DataFrame, updates: DataFrame, seq: str | None = None) -> DataFrame:
    """The table after the updates: they win over entries of the same key, among them the last by ``seq``."""
    if seq:
        updates = updates.groupBy("k").agg(F.max_by("v", seq).alias("v"))
    return table.join(updates, "k", "left_anti").select("k", "v").unionByName(updates.select("k", "v"))


def put_if_absent(table: DataFrame, updates: DataFrame) -> DataFrame:
    """The table with those updates whose key it lacks."""
    return table.select("k", "v").unionByName(updates.select("k", "v").join(table, "k", "left_anti"))


def appended_in_order(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with rows that must all come after its last key; an error when run if one doesn't."""
    late = F.coalesce(F.col("k") <= table.agg(F.max("k")).scalar(), F.lit(False))
    checked = rows.withColumn("k", F.when(late, F.raise_error(F.concat(F.lit("key out of order: "), F.col("k").cast("string")))).otherwise(F.col("k")))
    return table.select("k", "v").unionByName(checked.select(F.col("k").cast(table.schema["k"].dataType).alias("k"), "v"))


def delete(table: DataFrame, keys: DataFrame, exact: bool = False) -> DataFrame:
    """The table without the given keys, or with ``exact`` without the given pairs."""
    return table.join(keys, ["k", "v"] if exact else ["k"], "left_anti")


def chunks(table: DataFrame, n: int) -> Iterator[DataFrame]:
    """The table in about ``n`` ranges of its key, one after another: a long walk whose parts are read, and may be committed,
    on their own. Ranges are cut at quantiles, follow each other without a gap and don't depend on how often a key occurs;
    rows of one key stay together. NULL keys come last, in a part of their own."""
    bounds = table.where("k is not null").agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10_000)).first()[0] or [] if n > 1 else []
    ends = [None, *sorted(set(bounds)), None]
    for low, high in zip(ends, ends[1:]):
        yield table.where(F.col("k").isNotNull() & _bounds(F.col("k"), low, high, True))
    yield table.where("k is null")


def read_ahead(table: DataFrame, start, n: int) -> DataFrame:
    """The ``n`` entries from key ``start`` on, read once and kept in memory by the executors; unpersist() lets go of them."""
    ahead = key_range(table, start, limit=n).persist()
    ahead.count()
    return ahead
