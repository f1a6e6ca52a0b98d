"""Mutations over a base table, differences between tables, and coherent versioned caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronolake.operators.ordered import running


def read_through(base: DataFrame, put: DataFrame, deleted: DataFrame, cleared: bool = False) -> DataFrame:
    """(``k``, ``v``): the base with pending changes over it. A key that is put isn't deleted; a cleared base shows nothing."""
    new = put.select("k", "v")
    if cleared:
        return new
    hidden = deleted.select("k").union(put.select("k")).distinct()
    return base.select("k", "v").join(hidden, "k", "left_anti").unionByName(new)


def compact_mutations(mutations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Puts and deletions of a list of mutations (``seq``, ``op``: put, delete, ``k``, ``v``): the last of each key counts."""
    last = mutations.groupBy("k").agg(F.max(F.struct("seq", "op", "v")).alias("x")).select("k", "x.op", "x.v")
    return last.where("op = 'put'").select("k", "v"), last.where("op = 'delete'").select("k")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(``k``, ``op``, ``v``): what turns the old table into the new one: insert, update or delete. One row a key each."""
    a = old.select("k", F.col("v").alias("__old"), F.lit(True).alias("__in_old"))
    b = new.select("k", "v", F.lit(True).alias("__in_new"))
    both = a.join(b, "k", "full_outer")
    op = F.when(F.col("__in_old").isNull(), "insert").when(F.col("__in_new").isNull(), "delete").when(~F.col("__old").eqNullSafe(F.col("v")), "update")
    return both.select("k", op.alias("op"), "v").where("op is not null")


def apply_diff(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The old table after the changes that ``diff`` lists."""
    kept = old.select("k", "v").join(changes.select("k"), "k", "left_anti")
    return kept.unionByName(changes.where("op <> 'delete'").select("k", "v"))


# caches: (``version``, ``k``, ``v``) change rows, v NULL for a removal


def view_at(changes: DataFrame, version: int) -> DataFrame:
    """(``k``, ``v``): what a cache knows at a state version, removals as NULL."""
    return changes.where(F.col("version") <= version).groupBy("k").agg(F.max(F.struct("version", "v")).alias("x")).select("k", F.col("x.v").alias("v"))


def get_through(cache: DataFrame, base: DataFrame, keys: DataFrame) -> DataFrame:
    """(``k``, ``v``, ``hit``) for different keys: from the cache if it knows the key, else from the base."""
    c = cache.select("k", F.col("v").alias("__c"), F.lit(True).alias("__hit"))
    b = base.select("k", F.col("v").alias("__b"))
    x = keys.select("k").distinct().join(c, "k", "left").join(b, "k", "left")
    hit = F.coalesce("__hit", F.lit(False))
    return x.select("k", F.when(hit, F.col("__c")).otherwise(F.col("__b")).alias("v"), hit.alias("hit"))


def evict(entries: DataFrame, limit: int) -> DataFrame:
    """Entries (``k``, ``size``, ``used``: a unique time of last use) that stay: the most recent whose sizes add up to at
    most ``limit``."""
    recent = entries.withColumn("__age", -F.col("used"))
    return running(recent, keys=[], time="__age", sums={"total": "size"}).where(F.col("total") <= limit).select("k", "size", "used", "total")


def keep_versions(changes: DataFrame, n: int) -> DataFrame:
    """Rows of the last ``n`` versions."""
    return changes.where(F.col("version") > changes.agg(F.max("version")).scalar() - n)


def incoherent(cache: DataFrame, base: DataFrame) -> DataFrame:
    """(``k``, ``cached``, ``stored``): what the cache says otherwise than the base."""
    x = cache.select("k", F.col("v").alias("cached")).join(base.select("k", F.col("v").alias("stored")), "k", "left")
    return x.where(~F.col("cached").eqNullSafe(F.col("stored")))


def versions(changes: DataFrame) -> DataFrame:
    """(``version``, ``n``, ``total``): changes a version and up to it; versions are few, one row each."""
    n = changes.groupBy("version").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("total", F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("version")))


class Batch:
    """Changes over a base table that are kept apart until they are flushed, with copies of its sequences."""

    def __init__(self, base: DataFrame, sequences: dict[str, int] | None = None) -> None:
        self.base, self.sequences, self.cleared, self._n = base.select("k", "v"), dict(sequences or {}), False, 0
        self._log: DataFrame | None = None

    def _add(self, rows: DataFrame) -> None:
        self._n += 1
        marked = rows.withColumn("seq", F.lit(self._n))
        self._log = marked if self._log is None else self._log.unionByName(marked)

    def put(self, rows: DataFrame) -> None:
        """Of several values for a key the greatest is taken."""
        self._add(rows.groupBy("k").agg(F.max("v").alias("v")).withColumn("op", F.lit("put")))

    def delete(self, keys: DataFrame) -> None:
        self._add(keys.select("k").distinct().withColumn("v", F.lit(None).cast(self.base.schema["v"].dataType)).withColumn("op", F.lit("delete")))

    def clear(self) -> None:
        self._log, self.cleared = None, True

    def increment(self, name: str, by: int) -> int:
        """The value of a sequence before it is increased; the base's own isn't touched."""
        before = self.sequences.get(name, 0)
        self.sequences[name] = before + by
        return before

    def read(self) -> DataFrame:
        """The base as it would be after a flush."""
        if self._log is None:
            return self.base.limit(0) if self.cleared else self.base
        put, deleted = compact_mutations(self._log)
        return read_through(self.base, put, deleted, self.cleared)
