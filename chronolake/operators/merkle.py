"""History of changing attributes from periodic snapshots, by Merkle comparison.

Keys are hashed into leaf buckets; a tree of hashes over the buckets is built for every snapshot. Going down from the root
only into branches that differ from the snapshot before gives the leaf buckets that changed; only their rows are compared.
``history_from_snapshots`` replays all snapshots at once, ``SnapshotHistory`` keeps the tree of the last state and appends
one snapshot after another.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolake.plans.skew import heavy_keys, plan_bytes
from chronolake.session import materialize
from chronolake.sources.manifest import Manifests

FAN_OUT = 32
#: Rows of one snapshot in a leaf: the fewer, the fewer unchanged rows are compared.
ROWS_IN_LEAF = 1
MAX_LEAVES = 1 << 30
MAX_SNAPSHOTS = 10_000
MAX_BROADCAST = 64 << 20
#: Nodes of a level from which on it is written; levels above are cheap to derive again.
WRITTEN = FAN_OUT**2


def row_hash(key: str, values: Sequence[str]) -> Column:
    """A hash of a row that tells NULL from everything else."""
    return F.xxhash64(key, *[F.col(v).isNull() for v in values], *values)


def _height(leaves: int) -> int:
    return max(1, math.ceil(math.log(max(2, leaves), FAN_OUT)))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast if what was written of it is small; a larger one is joined by a shuffle."""
    return F.broadcast(df) if plan_bytes(df) <= MAX_BROADCAST else df


def _changed(hashes: Column, i: Column, since: Column) -> Column:
    """Whether bucket ``i`` must be compared: its hash isn't the same all along from the snapshot it is held against."""
    return F.when(i == 0, F.get(hashes, F.lit(0)) != 0).otherwise(
        F.exists(F.sequence(F.get(since, i) + 1, i), lambda j: F.get(hashes, j) != F.get(hashes, j - 1))
    )


def changed_leaves(leaf_hashes: DataFrame, n: int, since: Sequence[int], leaves: int) -> DataFrame:
    """(``node``, ``changed``): of each leaf bucket the snapshots in which it differs, found from the root down.

    ``leaf_hashes``: (node, i, h), partitioned by node. ``since[i]``: the snapshot that snapshot i is held against.
    """
    every = F.sequence(F.lit(0), F.lit(n - 1))
    held = F.array(*[F.lit(x) for x in since])
    entries = leaf_hashes.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("i", "h"))).alias("m"))  # n entries at most
    level = materialize(entries.select("node", F.transform(every, lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("hs")), "leaves")
    levels, nodes = [level], leaves
    for _ in range(_height(leaves)):
        up = level.groupBy(F.floor(F.col("node") / FAN_OUT).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "hs"))).alias("c"))
        level = up.select("node", F.transform(every, lambda i: F.when(F.exists("c", lambda x: F.get(x.hs, i) != 0), F.xxhash64(F.transform("c", lambda x: F.get(x.hs, i)))).otherwise(F.lit(0).cast("long"))).alias("hs"))
        nodes = -(-nodes // FAN_OUT)
        level = materialize(level, "level") if nodes > WRITTEN else level
        levels.append(level)
    found = levels.pop().select("node", F.filter(every, lambda i: _changed(F.col("hs"), i, held)).alias("changed"))
    while levels:
        child = levels.pop().withColumn("__up", F.floor(F.col("node") / FAN_OUT))
        up = found.where(F.size("changed") > 0).select(F.col("node").alias("__up"), F.col("changed").alias("__in"))
        found = child.join(up, "__up").select("node", F.filter("__in", lambda i: _changed(F.col("hs"), i, held)).alias("changed"))
    return found.where(F.size("changed") > 0)


def history_from_snapshots(
    rows: DataFrame, snapshots: DataFrame, *, key: Column, at: str, tie: str, values: Sequence[str], complete: str = "complete", rows_in_leaf: int = ROWS_IN_LEAF
) -> DataFrame:
    """(``key``, ``valid_from``, ``valid_to``, values): every version of a key's ``values`` and the times between which it held.

    Of several rows for a key and snapshot the greatest ``tie`` counts. A key without a row in a complete snapshot is
    absent there; without one in an incomplete snapshot nothing is known of it. A version starts at the first snapshot
    that shows it and ends at the next that shows other values (NULL equals NULL) or absence; ``valid_to`` is -1 if none
    does. After an absence a new version starts.

    Rows are shuffled as two hashes for the tree; of the rows themselves only those of leaves that changed are. A key with
    very many rows, copies that is, is reduced before either.

    Rows with a NULL key or time, or with a time at which no snapshot was taken, are left out. ``complete`` NULL counts as
    incomplete. No rows or no snapshots give an empty result. There is one snapshots row per snapshot, at most
    MAX_SNAPSHOTS; more raise an error: append them to a SnapshotHistory, which has no limit.
    """
    spark = rows.sparkSession
    taken = snapshots.where(F.col(at).isNotNull()).groupBy(F.col(at).cast("long").alias("t")).agg(F.max(F.coalesce(complete, F.lit(False)))).orderBy("t").limit(MAX_SNAPSHOTS + 1).collect()
    if len(taken) > MAX_SNAPSHOTS:
        raise ValueError(f"more than {MAX_SNAPSHOTS} snapshots")
    n, whole = len(taken), [r[1] for r in taken]
    index = F.broadcast(spark.createDataFrame([(r[0], i) for i, r in enumerate(taken)], "__t bigint, __i int"))
    since, last = [], 0
    for i in range(n):
        since.append(last if whole[i] else max(0, i - 1))
        last = i if whole[i] else last
    d = rows.select(key.alias("__k"), F.col(at).cast("long").alias("__t"), tie, *values).where("__k is not null and __t is not null").join(index, "__t").drop("__t")
    heavy, total = heavy_keys(d.select(F.xxhash64("__k").alias("kh")), "kh")
    if heavy:
        hot = F.broadcast(spark.createDataFrame([(h,) for h in heavy], "__kh bigint"))
        match = F.xxhash64("__k") == F.col("__kh")
        once = d.join(hot, match, "left_semi").groupBy("__k", "__i").agg(F.max(F.struct(tie, *values)).alias("x")).select("__k", "x.*", "__i")
        d = d.join(hot, match, "left_anti").unionByName(once)
    leaves = int(min(MAX_LEAVES, max(1, total // (max(1, n) * rows_in_leaf))))
    d = d.withColumn("__node", F.pmod(F.xxhash64("__k"), F.lit(leaves)))
    # For the tree a row is two hashes: the rows themselves stay where they are. All that follows needs one shuffle.
    small = d.select(F.xxhash64("__k").alias("kh"), F.col("__i").alias("i"), F.col("__node").alias("node"), tie, row_hash("__k", values).alias("rh")).repartition("node")
    small = small.groupBy("node", "kh", "i").agg(F.max_by("rh", tie).alias("rh"))
    hashes = small.groupBy("node", "i").agg(F.bit_xor("rh").alias("x"), F.count(F.lit(1)).alias("c")).select("node", "i", F.xxhash64("x", "c").alias("h"))
    found = materialize(changed_leaves(hashes, max(1, n), since or [0], leaves).select(F.col("node").alias("__node"), F.col("changed").alias("__changed")), "changed")
    found = _bounded(found)

    full = F.array(*[F.lit(bool(x)) for x in whole or [False]])
    times = F.array(*[F.lit(r[0]).cast("long") for r in taken]) if taken else F.array(F.lit(0).cast("long"))
    absent = F.get(F.filter("__changed", lambda i: (i > F.col("__i")) & F.get(full, i)), F.lit(0))  # the next snapshot that would show absence
    kept = d.join(found, "__node").where(F.array_contains("__changed", F.col("__i"))).withColumn("__a", absent)
    kept = kept.select("__k", "__i", "__a", tie, *values).repartition("__k")
    kept = kept.groupBy("__k", "__i").agg(F.max(F.struct(tie, *values)).alias("__v"), F.min("__a").alias("__a"))
    kept = kept.select("__k", "__i", "__a", F.struct(*[F.col(f"__v.{v}").alias(v) for v in values]).alias("__v"))
    w = W.partitionBy("__k").orderBy("__i")
    kept = kept.select(
        "*", F.lag("__i").over(w).alias("__pi"), F.lag("__a").over(w).alias("__pa"), F.lag("__v").over(w).alias("__pv"), F.lead("__i").over(w).alias("__ni"), F.lead("__v").over(w).alias("__nv")
    )
    starts = F.col("__pi").isNull() | F.coalesce(F.col("__pa") < F.col("__i"), F.lit(False)) | ~F.col("__v").eqNullSafe(F.col("__pv"))
    vanishes = F.col("__a").isNotNull() & (F.col("__ni").isNull() | (F.col("__a") < F.col("__ni")))
    ends = F.when(vanishes, F.col("__a")).when(F.col("__ni").isNotNull() & ~F.col("__v").eqNullSafe(F.col("__nv")), F.col("__ni"))
    kept = kept.select("__k", "__i", "__v", starts.alias("__starts"), ends.alias("__end"))
    kept = kept.withColumn("__to", F.min("__end").over(w.rowsBetween(0, W.unboundedFollowing))).where("__starts")
    return kept.select(F.col("__k").alias("key"), F.get(times, F.col("__i")).alias("valid_from"), F.coalesce(F.get(times, F.col("__to")), F.lit(-1).cast("long")).alias("valid_to"), "__v.*")


class SnapshotHistory:
    """A history that grows by one snapshot at a time.

    Kept are the state (the rows of all keys that are there, with their leaf), its tree of hashes, level by level, and a log
    of changes that is only appended to. A snapshot's tree is compared with that of the state from the root down; only rows
    of leaves that differ are compared. One manifest makes a snapshot's changes, state and tree visible together, so a run
    that died is done again. ``key`` and ``values`` name columns of the snapshots; ``leaves`` must stay the same.
    """

    def __init__(self, spark: SparkSession, path: str, *, key: str, values: Sequence[str], tie: str, leaves: int = 1 << 15) -> None:
        self.spark, self.path, self.key, self.values, self.tie, self.leaves = spark, path.rstrip("/"), key, list(values), tie, leaves
        self.manifests = Manifests(spark, self.path, "snapshot")

    def _write_tree(self, leaf: DataFrame, at: str) -> list[DataFrame]:
        """Writes the tree over leaf hashes (node, h): the leaves, and the levels above, which are a fraction of them."""
        leaf.write.parquet(f"{at}/leaves")
        level, upper = self.spark.read.schema("node bigint, h bigint").parquet(f"{at}/leaves"), None
        for depth in range(1, _height(self.leaves) + 1):
            level = level.groupBy(F.floor(F.col("node") / FAN_OUT).alias("node")).agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("node", "h")))).alias("h"))
            marked = level.withColumn("depth", F.lit(depth))
            upper = marked if upper is None else upper.union(marked)
        upper.write.parquet(f"{at}/upper")
        return self._read_tree(at)

    def _read_tree(self, at: str) -> list[DataFrame]:
        """Levels from the leaves up."""
        leaves = self.spark.read.schema("node bigint, h bigint").parquet(f"{at}/leaves")
        upper = self.spark.read.schema("node bigint, h bigint, depth int")
        return [leaves, *[upper.parquet(f"{at}/upper").where(F.col("depth") == d).select("node", "h") for d in range(1, _height(self.leaves) + 1)]]

    def _differing(self, old: list[DataFrame] | None, new: list[DataFrame]) -> DataFrame:
        """(``node``): leaves whose hashes differ, those of one side only too."""
        if old is None:
            return new[0].select("node")
        inside = None
        for a, b in zip(reversed(old), reversed(new)):
            if inside is not None:  # only children of branches that differ
                branch = _bounded(inside.select(F.col("node").alias("__up")))
                a, b = (x.join(branch, F.floor(F.col("node") / FAN_OUT) == F.col("__up"), "left_semi") for x in (a, b))
            both = a.select("node", F.col("h").alias("was")).join(b, "node", "full_outer")
            inside = both.where(~F.col("was").eqNullSafe(F.col("h"))).select("node")
        return inside

    def _leaf_hashes(self, state: DataFrame) -> DataFrame:
        return state.groupBy("node").agg(F.bit_xor(row_hash(self.key, self.values)).alias("x"), F.count(F.lit(1)).alias("c")).select("node", F.xxhash64("x", "c").alias("h"))

    def append(self, rows: DataFrame, at: int, complete: bool = True) -> int:
        """Takes the snapshot of time ``at``, later than all before; the number of the version. Rows with a NULL key are left
        out, of several for a key the greatest by ``tie`` counts. In an incomplete snapshot missing keys stay as they were."""
        version, old = self.manifests.last()
        if old is not None and at <= old["at"]:
            raise ValueError(f"snapshot {at} isn't later than {old['at']}")
        work = f"{self.path}/snapshot-{uuid.uuid4().hex}"
        once = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(self.tie, *self.values)).alias("x")).select(self.key, *[F.col(f"x.{v}").alias(v) for v in self.values])
        once.withColumn("node", F.pmod(F.xxhash64(self.key), F.lit(self.leaves))).write.parquet(f"{work}/rows")
        new = self.spark.read.parquet(f"{work}/rows")
        tree = self._write_tree(self._leaf_hashes(new), f"{work}/seen")
        was = self.spark.read.schema(new.schema).parquet(old["state"]) if old else None
        held = self._read_tree(old["tree"]) if old else None
        leaf = materialize(self._differing(held, tree), "differing")
        now = new.join(_bounded(leaf), "node", "left_semi").select(self.key, F.struct(*self.values).alias("v"), F.lit(True).alias("here"))
        before = (was.join(_bounded(leaf), "node", "left_semi") if old else new.limit(0)).select(self.key, F.struct(*self.values).alias("o"), F.lit(True).alias("there"))
        both = now.join(before, self.key, "full_outer")
        starts = F.col("here") & (F.col("there").isNull() | ~F.col("v").eqNullSafe(F.col("o")))
        ends = F.col("here").isNull() if complete else F.lit(False)
        changes = both.where(F.coalesce(starts, F.lit(False)) | ends).select(self.key, F.lit(at).cast("bigint").alias("at"), F.coalesce("here", F.lit(False)).alias("live"), "v.*")
        changes.write.parquet(f"{work}/changes")
        if complete or not old:
            state, hashes = f"{work}/rows", f"{work}/seen"
        else:
            state, hashes = f"{work}/state", f"{work}/tree"
            new.unionByName(was.join(new.select(self.key), self.key, "left_anti")).write.parquet(state)
            self._write_tree(self._leaf_hashes(self.spark.read.parquet(state)), hashes)
        return self.manifests.publish(version, {"at": at, "state": state, "tree": hashes, "changes": [*(old["changes"] if old else []), f"{work}/changes"]})

    def versions(self) -> DataFrame | None:
        """(``key``, ``valid_from``, ``valid_to``, values) of all snapshots taken; None before the first."""
        _, body = self.manifests.last()
        if body is None:
            return None
        w = W.partitionBy(self.key).orderBy("at")
        log = self.spark.read.parquet(*body["changes"]).withColumn("valid_to", F.coalesce(F.lead("at").over(w), F.lit(-1).cast("bigint")))
        return log.where("live").select(F.col(self.key).alias("key"), F.col("at").alias("valid_from"), "valid_to", *self.values)
