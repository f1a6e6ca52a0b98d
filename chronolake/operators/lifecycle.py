"""The life of a log in tiers: collate into steps, merge steps, prune, unwind."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.operators.ordered import running
from chronolake.sources.manifest import Manifests
from chronolake.sources.store import VersionedTable

MERGED_STEPS = 32


def step_of(step: int) -> Column:
    return F.floor(F.col("tx") / step).cast("bigint")


def collate_index(log: DataFrame, step: int) -> DataFrame:
    """(``step``, ``k``, ``n``, ``first_tx``, ``last_tx``): the entries a step file holds for each key."""
    once = log.select(step_of(step).alias("step"), "k", "tx").distinct()
    return once.groupBy("step", "k").agg(F.count(F.lit(1)).alias("n"), F.min("tx").alias("first_tx"), F.max("tx").alias("last_tx"))


def collate_domain(log: DataFrame, step: int) -> DataFrame:
    """(``step``, ``k``, ``v``): the last value of each key in each step."""
    return log.groupBy(step_of(step).alias("step"), "k").agg(F.max(F.struct("tx", "v")).alias("x")).select("step", "k", F.col("x.v").alias("v"))


def collate_oldest(hot: DataFrame, step: int) -> DataFrame:
    """(``step``, ``k``, ``v``): of each key of the hot log the oldest step it is still in, and its last value there. What a
    step's file takes are the rows of that step: keys with an older step left wait for it to be collated and pruned."""
    at = F.struct(-step_of(step), "tx", "v")
    return hot.groupBy("k").agg(F.max(at).alias("x")).select((-F.col("x.col1")).alias("step"), "k", F.col("x.v").alias("v"))


def write_steps(frame: DataFrame, path: str, mode: str = "append") -> None:
    """Step files: one folder a step, keys in ranges and sorted, so footers prune both time and keys."""
    frame.repartitionByRange("step", "k").sortWithinPartitions("step", "k").write.mode(mode).partitionBy("step").parquet(path)


def read_steps(spark: SparkSession, path: str, first: int | None = None, end: int | None = None) -> DataFrame:
    """Steps in [first, end); other folders aren't opened."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("step") >= first)
    return df if end is None else df.where(F.col("step") < end)


def merge_span(end_step: Column, most: int = MERGED_STEPS) -> Column:
    """The length of the largest aligned power-of-two range that ends at a step, at most ``most``."""
    return F.least(end_step.bitwiseAND(-end_step), F.lit(most))


def merge_candidates(files: DataFrame) -> DataFrame:
    """(``name``, ``start_step``, ``end_step``, ``merge_from``): files with the start of the range they complete, where
    that begins before the file does. The range to merge next is the one that starts first."""
    x = files.withColumn("merge_from", F.col("end_step") - merge_span(F.col("end_step")))
    return x.where(F.col("merge_from") < F.col("start_step"))


def next_merge(files: DataFrame) -> tuple[int, int] | None:
    """The range of steps to merge next, the earliest start and the longest there; None if a file already spans it."""
    row = merge_candidates(files).agg(F.min(F.struct("merge_from", -F.col("end_step"))).alias("x")).select("x.*").first()
    if row is None or row[0] is None:
        return None
    start, end = row[0], -row[1]
    done = files.where((F.col("start_step") <= start) & (F.col("end_step") >= end))
    return None if not done.isEmpty() else (start, end)


def merged_plan(ranges: list[tuple[int, int]], most: int = MERGED_STEPS) -> list[tuple[int, int]]:
    """What is left when ranges of steps have been merged until nothing is left to merge. Works on the manifest, which has
    one entry a file."""
    files = set(ranges)
    while True:
        found = [(end - min(end & -end, most), -end) for start, end in files if end - min(end & -end, most) < start]
        if not found:
            return sorted(files)
        start, end = min(found)[0], -min(found)[1]
        files = {f for f in files if not (start <= f[0] and f[1] <= end)} | {(start, end)}


def not_covered(files: DataFrame) -> DataFrame:
    """Files that no other, longer file of the same name contains; an interval containment by running maxima.

    Files in order of start, longest first: one is contained if an earlier one ends at or after it."""
    once = files.select("name", "start_step", "end_step").distinct().withColumn("__len", F.col("start_step") - F.col("end_step")).withColumn("__neg", -F.col("end_step"))
    # the least negated end up to the row before is the greatest end before
    r = running(once, keys=["name"], time="start_step", ties=["__len"], mins={"__before": "__neg"}, before=True)
    return r.where(F.col("__before").isNull() | (F.col("__neg") < F.col("__before"))).select("name", "start_step", "end_step")


def merge_domain(steps: DataFrame, first: int, end: int) -> DataFrame:
    """(``k``, ``v``): one file of the steps in [first, end); the newest value wins. A range from 0 drops deleted keys:
    nothing older can show through."""
    x = steps.where((F.col("step") >= first) & (F.col("step") < end)).groupBy("k").agg(F.max(F.struct("step", "v")).alias("x")).select("k", F.col("x.v").alias("v"))
    return x.where("v is not null") if first == 0 else x


def rollup_steps(collated: DataFrame, level: int) -> DataFrame:
    """Index entries of ranges of 2**level steps from those of single steps."""
    g = collated.groupBy(F.shiftright("step", level).alias("span"), "k")
    return g.agg(F.sum("n").alias("n"), F.min("first_tx").alias("first_tx"), F.max("last_tx").alias("last_tx"))


def prune(log: DataFrame, start: int, end: int) -> DataFrame:
    """The hot log without [start, end)."""
    return log.where((F.col("tx") < start) | (F.col("tx") >= end))


def prune_domain(collated: DataFrame, before: int) -> DataFrame:
    """Step entries without those before step ``before`` that a newer entry of the key hides."""
    last = collated.groupBy("k").agg(F.max("step").alias("__last"))
    return collated.join(last, "k").where((F.col("step") >= before) | (F.col("step") == F.col("__last"))).drop("__last")


def unwind(log: DataFrame, at: int) -> DataFrame:
    """The log as it was before ``at``; the latest state follows from it."""
    return log.where(F.col("tx") < at)


def steps_range(log: DataFrame, step: int) -> DataFrame:
    """(``first_step``, ``last_step``) of the hot log, as fractions."""
    return log.agg((F.min("tx") / step).alias("first_step"), (F.max("tx") / step).alias("last_step"))


def low_water_mark(index: DataFrame) -> DataFrame:
    """(``mark``): the time up to which every index has data."""
    return index.groupBy("name").agg(F.max("tx").alias("m")).agg(F.min("m").alias("mark"))


def can_prune_from(a: DataFrame, b: DataFrame) -> DataFrame:
    """(``first_tx``): the earliest time in either of two hot tables."""
    return a.select("tx").union(b.select("tx")).agg(F.min("tx").alias("first_tx"))


def hot_steps(log: DataFrame, step: int, keep: int) -> DataFrame:
    """(``step``, ``n``, ``tier``): rows a step; the last ``keep`` steps stay hot, earlier ones are to be built into files."""
    last = log.agg(F.max(step_of(step))).scalar()
    n = log.groupBy(step_of(step).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("step", "n", F.when(F.col("step") > last - keep, "hot").otherwise("file").alias("tier"))


def stats(collated: DataFrame) -> DataFrame:
    """(``step``, ``keys``, ``entries``): what the files hold."""
    return collated.groupBy("step").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("entries"))


def integrate(files: DataFrame, merged: DataFrame) -> DataFrame:
    """The listing (``name``, ``start_step``, ``end_step``) once merged files have joined it: files inside a longer one are gone."""
    cols = ["name", "start_step", "end_step"]
    return not_covered(files.select(cols).unionByName(merged.select(cols)))


def garbage(files: DataFrame, merged: DataFrame) -> DataFrame:
    """Files that the merged ones make superfluous; they may be deleted when no reader is at them any more."""
    cols = ["name", "start_step", "end_step"]
    return files.select(cols).distinct().join(integrate(files, merged), cols, "left_anti")


def prune_in_time(store: VersionedTable, start: int, end: int, *, batch: int, seconds: float, clock: Callable[[], float] = time.monotonic) -> int:
    """Prunes [start, end) of a stored hot log, ``batch`` times at once, until the time is up; from where the next call must go
    on (``end`` when all is done). Each batch is a version of its own, so a call that is cut off loses nothing."""
    until, at = clock() + seconds, start
    while at < end and clock() < until:
        upto = min(end, at + batch)
        store.update(lambda log, a=at, z=upto: prune(log, a, z))
        at = upto
    return at


class Wal:
    """Writes that wait in a folder: ``rotate`` takes those there are, ``flush`` makes them part of the hot log at once,
    ``discard`` drops those that wait. What was flushed is named by a manifest, so a batch counts once or not at all."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, self.path, "flushed")
        self.waiting: list[str] = []

    def write(self, batch: DataFrame) -> None:
        at = f"{self.path}/batch-{uuid.uuid4().hex}"
        batch.write.parquet(at)
        self.waiting.append(at)

    def rotate(self) -> list[str]:
        taken, self.waiting = self.waiting, []
        return taken

    def flush(self, taken: list[str]) -> int:
        version, body = self.manifests.last()
        return self.manifests.publish(version, {"batches": [*(body or {"batches": []})["batches"], *taken]})

    def discard(self) -> None:
        for at in self.rotate():
            self.manifests.delete_folder(at)

    def hot(self) -> DataFrame | None:
        """All flushed writes; None before the first."""
        _, body = self.manifests.last()
        return self.spark.read.parquet(*body["batches"]) if body and body["batches"] else None


def build_missed(spark: SparkSession, steps: str, indices: str, step: int) -> list[int]:
    """Writes the index entries of those step files below ``steps`` that have none below ``indices`` yet; their numbers. Other
    steps aren't read."""
    at = Manifests(spark, indices, "none")
    there = {int(n.split("=")[1]) for n in at.folders(steps) if n.startswith("step=")}
    missing = sorted(there - {int(n.split("=")[1]) for n in at.folders(indices) if n.startswith("step=")})
    if missing:
        write_steps(collate_index(spark.read.parquet(steps).where(F.col("step").isin(missing)), step), indices)
    return missing
