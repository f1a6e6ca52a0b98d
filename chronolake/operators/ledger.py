"""Processing only new or changed records: a ledger of processed sequence numbers, kept as disjoint intervals."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolake.operators.asof import as_known_at
from chronolake.operators.intervals import periods_and_gaps
from chronolake.plans.skew import heavy_keys
from chronolake.sources.manifest import Manifests

MAX_BROADCAST_INTERVALS = 100_000
#: Intervals that a cell of the grid may hold.
CROWDED = 8
LOWEST = -(2**63)


def merge_intervals(intervals: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Half-open intervals as disjoint ones that don't touch. NULL and empty intervals are left out."""
    p = periods_and_gaps(intervals.withColumn("__one", F.lit(0)), entity="__one", start=lo, end=hi)
    return p.where("kind = 'period'").select(lo, hi)


def runs_of(numbers: DataFrame, seq: str) -> DataFrame:
    """(``lo``, ``hi``): whole numbers as half-open intervals. Numbers are sorted by ranges and joined inside each range, so
    there are no more intervals than true ones and one a range."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = None
        for batch in batches:
            x = np.unique(batch.column(0).to_numpy())
            if not len(x):
                continue
            cut = np.flatnonzero(np.diff(x) != 1)
            los, his = x[np.r_[0, cut + 1]].tolist(), (x[np.r_[cut, len(x) - 1]] + 1).tolist()
            if lo is not None:
                if los[0] <= hi:
                    los[0], his[0] = lo, max(hi, his[0])
                else:
                    los, his = [lo, *los], [hi, *his]
            lo, hi = los[-1], his[-1]
            yield pa.RecordBatch.from_arrays([pa.array(los[:-1], pa.int64()), pa.array(his[:-1], pa.int64())], ["lo", "hi"])
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([hi], pa.int64())], ["lo", "hi"])

    n = numbers.where(F.col(seq).isNotNull()).select(F.col(seq).cast("bigint").alias("n"))
    return n.repartitionByRange("n").sortWithinPartitions("n").mapInArrow(join, "lo bigint, hi bigint")


def locate(rows: DataFrame, seq: str, intervals: DataFrame, *, lo: str = "lo", hi: str = "hi", outside: bool = False) -> DataFrame:
    """Each row with the columns of the interval that its number lies in; with ``outside`` the rows that lie in none instead.

    The intervals are half-open and disjoint. What this costs doesn't depend on how long they are. Up to
    MAX_BROADCAST_INTERVALS are laid on a grid of about four cells an interval and broadcast, unless that crowds more than
    CROWDED into a cell; others are merged with the rows in order, as versions that hold from ``lo`` on. Rows with a NULL
    number are left out.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col(seq).isNotNull())
    intervals = intervals.where(F.col(lo) < F.col(hi))
    rest = [c for c in intervals.columns if c not in (lo, hi)]
    some = np.array([tuple(r) for r in intervals.select(F.col(lo).cast("bigint"), F.col(hi).cast("bigint")).limit(MAX_BROADCAST_INTERVALS + 1).collect()], np.int64).reshape(-1, 2)
    if not len(some):
        return rows if outside else rows.where(F.lit(False)).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in intervals.schema])
    if len(some) <= MAX_BROADCAST_INTERVALS:
        first, last = int(some[:, 1].min()) - 1, int(some[:, 1].max())  # all below the first end is one cell
        width = max(1, (last - first) // (4 * len(some)))
        from_cell, to_cell = (np.maximum(some[:, 0], first) - first) // width, (some[:, 1] - 1 - first) // width
        ends = np.bincount(np.unique(np.r_[from_cell, to_cell + 1], return_inverse=True)[1], np.r_[np.ones(len(some)), -np.ones(len(some))])
        if np.cumsum(ends).max() <= CROWDED:
            cell = lambda x: F.floor((F.greatest(x, F.lit(first)) - F.lit(first)) / width)
            grid = intervals.withColumn("__cell", F.explode(F.sequence(cell(F.col(lo)), cell(F.col(hi) - 1))))
            grid = F.broadcast(grid.select("__cell", F.col(lo).alias("__g_lo"), F.col(hi).alias("__g_hi"), *rest))
            inside = (F.col("__cell") == cell(F.col(seq))) & (F.col(seq) >= F.col("__g_lo")) & (F.col(seq) < F.col("__g_hi"))
            if outside:
                return rows.join(grid, inside, "left_anti")
            return rows.where(F.col(seq) < last).join(grid, inside).drop("__cell").withColumnsRenamed({"__g_lo": lo, "__g_hi": hi})
    known = intervals.select(F.lit(0).alias("__one"), F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), *[F.col(c).alias(f"__p_{c}") for c in rest])
    asked = rows.withColumn("__one", F.lit(0)).withColumn("__n", F.col(seq))
    met = as_known_at(asked, known, key="__one", event_time="__n", order=["__lo"], available=["__lo"], payload=["__hi", *[f"__p_{c}" for c in rest]], how="left").drop("__one", "__n")
    if outside:
        return met.where(F.col("__hi").isNull() | (F.col(seq) >= F.col("__hi"))).select(*rows.columns)
    return met.where(F.col(seq) < F.col("__hi")).withColumnsRenamed({"__lo": lo, "__hi": hi} | {f"__p_{c}": c for c in rest})


def pending(source: DataFrame, seq: str, processed: DataFrame) -> DataFrame:
    """Rows of ``source`` whose number lies in no half-open interval (lo, hi) of ``processed``, which are disjoint. Rows with a
    NULL number are never processed and left out."""
    return locate(source, seq, processed.select(F.col("lo").alias("__a"), F.col("hi").alias("__z")), lo="__a", hi="__z", outside=True)


class Ledger:
    """Runs that process each sequence number exactly once, late numbers and failed runs included.

    A run subtracts the processed intervals from the numbers present in the source, processes the rest, writes the output
    and the merged intervals beside each other and commits both by one manifest. Before that nothing of a run can be seen;
    a run that died is simply done again. ``path`` must be on storage all executors share.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, self.path, "commit")

    def manifest(self) -> dict:
        """The last committed state: version, folder of intervals, folders of output."""
        version, body = self.manifests.last()
        return {"version": version, **(body or {"intervals": None, "output": []})}

    def processed(self) -> DataFrame:
        """(lo, hi): the half-open, disjoint intervals processed so far."""
        at = self.manifest()["intervals"]
        return self.spark.read.schema("lo bigint, hi bigint").parquet(at) if at else self.spark.createDataFrame([], "lo bigint, hi bigint")

    def output(self) -> DataFrame | None:
        """All committed output; None before the first commit."""
        at = self.manifest()["output"]
        return self.spark.read.parquet(*at) if at else None

    def run(self, source: DataFrame, seq: str, process: Callable[[DataFrame], DataFrame]) -> int | None:
        """Processes what is new and commits it; the new version, or None if nothing was new."""
        state = self.manifest()
        done = self.processed()
        new = pending(source, seq, done)
        work = f"{self.path}/run-{uuid.uuid4().hex}"
        new.write.parquet(f"{work}/input")  # the numbers that count as processed are exactly those of the rows read here
        taken = self.spark.read.schema(new.schema).parquet(f"{work}/input")
        if taken.isEmpty():
            self.manifests.delete_folder(work)
            return None
        process(taken).write.parquet(f"{work}/output")
        merge_intervals(done.union(runs_of(taken, seq))).write.parquet(f"{work}/intervals")
        return self._commit(state["version"], {"intervals": f"{work}/intervals", "output": [*state["output"], f"{work}/output"]})

    def _commit(self, after: int, body: dict) -> int:
        return self.manifests.publish(after, body)


def subtract(lo: int, hi: int, done: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of [lo, hi) in none of the disjoint, sorted intervals ``done``."""
    gaps = []
    for a, b in done[max(0, bisect_right(done, (lo, lo)) - 1) :]:
        if a >= hi:
            break
        if lo < a:
            gaps.append((lo, a))
        lo = max(lo, b)
    return gaps + ([(lo, hi)] if lo < hi else [])


def insert(lo: int, hi: int, done: list[tuple[int, int]]) -> None:
    """Merges [lo, hi) into the disjoint, sorted intervals ``done``, in place; intervals that touch become one."""
    first = max(0, bisect_right(done, (lo, lo)) - 1)
    first += first < len(done) and done[first][1] < lo
    last = first
    while last < len(done) and done[last][0] <= hi:
        lo, hi, last = min(lo, done[last][0]), max(hi, done[last][1]), last + 1
    done[first:last] = [(lo, hi)]


def run_gaps(runs: DataFrame, *, run_id: str, cutoff: str, ok: Column, since: str | None = None) -> DataFrame:
    """(``run_id``, ``__rank``, ``__lo``, ``__hi``): what each successful run has to process of the sequence axis, half-open.

    Available to a run is everything below its cutoff (inclusive, so ``__hi`` is one more), from ``since`` on where that is
    given and not NULL. The runs are replayed in order of their cutoffs: each subtracts the intervals processed so far and
    adds what it took. A run has a row for each gap; one that finds none, or has no cutoff, has no row. ``runs`` has one row
    a run and is replayed in one task.
    """
    begins = F.coalesce(sequence_of(F.col(since)), F.lit(LOWEST)) if since else F.lit(LOWEST)
    r = runs.where(ok & F.col(cutoff).isNotNull()).select(run_id, begins.alias("__lo"), (sequence_of(F.col(cutoff)) + 1).alias("__hi"))
    kind = r.schema[run_id].dataType.simpleString()

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int]] = []
        rank = 0
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for run, lo, hi in zip(*[c.to_pylist() for c in batch.columns]):
                rank += 1
                for gap in subtract(lo, hi, done):
                    for column, x in zip(out, (run, rank, *gap)):
                        column.append(x)
                if lo < hi:
                    insert(lo, hi, done)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], [run_id, "__rank", "__lo", "__hi"])

    return r.coalesce(1).sortWithinPartitions("__hi", run_id).mapInArrow(replay, f"`{run_id}` {kind}, __rank int, __lo bigint, __hi bigint")


def sequence_of(at: Column) -> Column:
    """A timestamp as a sequence number, in microseconds."""
    return F.unix_micros(at.cast("timestamp"))


def assign_gaps(rows: DataFrame, seq: str, gaps: DataFrame) -> DataFrame:
    """Each row with the columns of the gap its number lies in; rows outside all gaps are left out."""
    return locate(rows, seq, gaps, lo="__lo", hi="__hi")


def new_or_changed(log: DataFrame, gaps: DataFrame, *, record: Sequence[str], seq: Column, tie: str, values: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of the rows that a run takes as new or changed, with the columns of its gap.

    Of each record a run takes the last row in its gap (by ``seq``, then ``tie``). It counts if no earlier run saw the
    record, or if ``values`` differ from what was last taken (NULL equals NULL). Rows are shuffled once, by their record;
    copies of a record that is delivered very often are reduced before that, so it is no hot spot.

    Rows without a sequence number are never seen. A NULL in ``record`` is a value like others; drop such rows before if
    they don't count. An empty log or no successful run gives an empty result.
    """
    cols = list(dict.fromkeys([*record, tie, *values, *keep]))
    seen = assign_gaps(log.select(*cols, seq.alias("__seq")).where("__seq is not null"), "__seq", gaps)
    gap = [c for c in gaps.columns if c not in ("__lo", "__hi")]
    rest = [c for c in cols if c not in (*record, tie)]
    seen = seen.select(*record, *gap, "__seq", tie, *rest)

    def last(rows: DataFrame) -> DataFrame:
        x = rows.groupBy(*record, *gap).agg(F.max(F.struct("__seq", tie, *rest)).alias("__x"))
        return x.select(*record, *gap, *[F.col(f"__x.{c}").alias(c) for c in ("__seq", tie, *rest)])

    heavy, _ = heavy_keys(log.select(F.xxhash64(*record).alias("__rh")), "__rh")
    if heavy:
        hot = F.broadcast(log.sparkSession.createDataFrame([(h,) for h in heavy], "__rh bigint"))
        match = F.xxhash64(*record) == F.col("__rh")
        seen = seen.join(hot, match, "left_anti").unionByName(last(seen.join(hot, match, "left_semi")))
    taken = last(seen.repartition(*record)).drop("__seq")
    order = W.partitionBy(*record).orderBy("__rank")
    taken = taken.withColumn("__before", F.lag("__rank").over(order)).withColumn("__old", F.lag(F.struct(*values)).over(order))
    return taken.where(F.col("__before").isNull() | ~F.struct(*values).eqNullSafe(F.col("__old"))).select(*gap, *keep)
