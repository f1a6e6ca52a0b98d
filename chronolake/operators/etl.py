"""Extract, transform to any number of rows, sort, load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def extract(source: DataFrame, start=None, end=None, *, outputs: list[Column] | None = None, seq: str | None = None) -> DataFrame:
    """Rows with start <= k < end, each turned into the given pairs (structs of ``k`` and ``v``; NULL pairs are dropped). With
    ``seq`` its column and ``part``, the position of a pair among those of its row, tell in what order pairs came."""
    if start is not None:
        source = source.where(F.col("k") >= start)
    if end is not None:
        source = source.where(F.col("k") < end)
    if outputs is None:
        return source
    if seq is None:
        return source.select(F.explode(F.array(*outputs)).alias("x")).where("x is not null").select("x.k", "x.v")
    return source.select(seq, F.posexplode(F.array(*outputs)).alias("part", "x")).where("x is not null").select("x.k", "x.v", seq, "part")


def sort_stable(rows: DataFrame, seq: str) -> DataFrame:
    """Rows in the order of their key, those of one key as they came: an external sort over all executors."""
    return rows.orderBy("k", seq)


def load_all(rows: DataFrame) -> DataFrame:
    """All rows, repeated keys too."""
    return rows.select("k", "v")


def load_appended(rows: DataFrame, seq: str, glue: str = "") -> DataFrame:
    """(``k``, ``v``): values of a key joined in the order of ``seq``. A key's result is one value by nature."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(seq, "v"))), lambda x: x.v)
    return rows.groupBy("k").agg(F.array_join(parts, glue).alias("v"))


def load_oldest(rows: DataFrame, seq: str) -> DataFrame:
    """(``k``, ``v``): the first value of each key."""
    return rows.groupBy("k").agg(F.min(F.struct(seq, "v")).alias("x")).select("k", F.col("x.v").alias("v"))


def load_onto(target: DataFrame, rows: DataFrame, merge: Column | None = None) -> DataFrame:
    """The target after loading one row a key. A NULL value deletes the key. ``merge`` makes the value to store of
    ``v`` and ``old``, the value the target has."""
    new = rows.select("k", F.col("v").alias("__new"), F.lit(True).alias("__is_new"))
    both = target.select("k", F.col("v").alias("old")).join(new, "k", "full_outer")
    value = F.col("__new") if merge is None else merge
    both = both.withColumn("v", F.col("__new"))
    return both.select("k", F.when(F.col("__is_new"), F.when(F.col("__new").isNotNull(), value)).otherwise(F.col("old")).alias("v")).where("v is not null")


def transform(source: DataFrame, target: DataFrame, *, outputs: list[Column], start=None, end=None, seq: str | None = None) -> DataFrame:
    """Extract from a source and load onto a target. Of several values of a key the last by ``seq`` is loaded, of those of one
    source row the one given last; without ``seq`` the greatest."""
    rows = extract(source, start, end, outputs=outputs, seq=seq)
    if seq is None:
        return load_onto(target, rows.groupBy("k").agg(F.max("v").alias("v")))
    last = rows.groupBy("k").agg(F.max(F.struct(F.col(seq), F.col("part"), F.col("v"))).alias("x"))
    return load_onto(target, last.select("k", F.col("x.v").alias("v")))


class Collector:
    """Pairs collected batch by batch in files, sorted by key, that outlive the collector: another one on the same folder goes
    on where it stopped. A batch is named, so one that is collected again replaces itself."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def collect(self, rows: DataFrame, batch: int) -> None:
        named = rows.select("k", "v").withColumn("part", F.monotonically_increasing_id())
        named.sortWithinPartitions("k").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def rows(self) -> DataFrame:
        """(``k``, ``v``, ``seq``): all pairs, numbered as they came."""
        return self.spark.read.parquet(self.path).select("k", "v", F.struct(F.col("batch"), F.col("part")).alias("seq"))

    def load(self, target: DataFrame) -> DataFrame:
        """The target after loading the last value of each key."""
        return load_onto(target, self.rows().groupBy("k").agg(F.max_by("v", "seq").alias("v")))


def following_key(key: Column) -> Column:
    """next_key of a binary column; an error when run if a key is empty or all 0xff. NULL stays NULL."""
    h = F.hex(key)
    kept = F.regexp_replace(h, "^((?:..)*?)(?:FF)*$", "$1")
    up = F.lpad(F.conv((F.conv(F.right(kept, F.lit(2)), 16, 10).cast("int") + 1).cast("string"), 10, 16), 2, "0")
    nxt = F.unhex(F.rpad(F.concat(F.left(kept, F.length(kept) - 2), up), F.length(h), F.lit("0")))
    return F.when(key.isNull(), None).when(F.length(kept) == 0, F.raise_error(F.lit("key has no next one"))).otherwise(nxt)


def next_key(key: bytes) -> bytes:
    """The key increased by one as a number of the same length; an error if it is empty or all 0xff."""
    n = int.from_bytes(key) + 1
    if not key or n >> (8 * len(key)):
        raise ValueError("key has no next one")
    return n.to_bytes(len(key))


def progress(key: Column) -> Column:
    """Roughly how many percent of the key space lie below a binary key, from its first byte."""
    return F.floor(F.shiftright(F.conv(F.hex(F.substring(key, 1, 1)), 16, 10).cast("int"), 4) * F.lit(3.3)).cast("int")
