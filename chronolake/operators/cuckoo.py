"""Has this key been seen before? Partitioned cuckoo filters, an exact check and the rate of wrong answers.

Keys are spread over buckets by their hash; each bucket has a filter of its own, so a filter's size, and with it the rate of
wrong answers, doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.plans.skew import heavy_keys

SLOTS = 4
KICKS = 256
FULL = 0.85
#: Rows of one bucket, which are held at once, and of one task; both about.
BUCKET_ROWS, PART_ROWS = 1 << 16, 1 << 22


class CuckooTable:
    """One table of 16-bit fingerprints; a key may lie in either of two buckets, each found from the other."""

    def __init__(self, log2_buckets: int) -> None:
        self.mask = np.uint64((1 << log2_buckets) - 1)
        self.cells = np.zeros((1 << log2_buckets, SLOTS), np.uint16)
        self.n = 0

    def prints(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of 64-bit hashes."""
        fp = (h >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        a = h & self.mask
        return fp, a.astype(np.int64), self.other(a, fp).astype(np.int64)

    def other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        mixed = fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (bucket.astype(np.uint64) ^ (mixed >> np.uint64(20))) & self.mask

    def firsts(self, h: np.ndarray) -> np.ndarray:
        """Places of the first of those hashes that the table can't tell apart: same fingerprint, same two buckets."""
        fp, a, b = self.prints(h)
        return np.sort(np.unique(np.minimum(a, b) << 16 | fp, return_index=True)[1])

    def has(self, h: np.ndarray) -> np.ndarray:
        fp, a, b = self.prints(h)
        return (self.cells[a] == fp[:, None]).any(1) | (self.cells[b] == fp[:, None]).any(1)

    def room(self) -> int:
        return int(self.cells.size * FULL) - self.n

    def _fill(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Puts what fits into free slots of the given buckets; which did."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        new = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
        rank = np.arange(len(b)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(b) else np.zeros(0, int)
        free = self.cells[b] == 0
        hit = free & (np.cumsum(free, 1) == rank[:, None] + 1)
        ok = hit.any(1)
        self.cells[b[ok], hit[ok].argmax(1)] = fp[order][ok]
        placed = np.zeros(len(b), bool)
        placed[order] = ok
        self.n += int(ok.sum())
        return placed

    def add(self, h: np.ndarray) -> np.ndarray:
        """Adds hashes; which found a place. A key that finds none leaves the table as it was."""
        fp, a, b = self.prints(h)
        placed = self._fill(a, fp)
        rest = np.flatnonzero(~placed)
        placed[rest] = self._fill(b[rest], fp[rest])
        for i in np.flatnonzero(~placed):
            placed[i] = self._kick(int(a[i]), fp[i])
        return placed

    def _kick(self, bucket: int, fp: np.uint16) -> bool:
        path = []
        for k in range(KICKS):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = fp
                self.n += 1
                return True
            slot = (bucket + k) % SLOTS
            path.append((bucket, slot, self.cells[bucket, slot]))
            self.cells[bucket, slot], fp = fp, self.cells[bucket, slot]
            bucket = int(self.other(np.array([bucket]), np.array([fp], np.uint16))[0])
        for at, slot, old in reversed(path):
            self.cells[at, slot] = old
        return False

    def remove(self, h: int) -> bool:
        fp, a, b = self.prints(np.array([h], np.uint64))
        for bucket in (a[0], b[0]):
            slot = np.flatnonzero(self.cells[bucket] == fp[0])
            if len(slot):
                self.cells[bucket, slot[0]] = 0
                self.n -= 1
                return True
        return False


class CuckooFilter:
    """A chain of cuckoo tables that gets a table of twice the size when the last one is full.

    Never says "new" of a key that was added and not removed; may say "seen" of others. Only keys that were added may be
    removed. 16 bits a key and 2 bytes a free slot; the keys themselves aren't kept.
    """

    def __init__(self, log2_buckets: int = 12) -> None:
        self.size = log2_buckets
        self.tables = [CuckooTable(log2_buckets)]

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), bool)
        for t in self.tables:
            found |= t.has(h)
        return found

    def _grow(self) -> None:
        self.size += 1
        self.tables.append(CuckooTable(self.size))

    def add(self, h: np.ndarray) -> None:
        while len(h):
            room = self.tables[-1].room()
            if room <= 0:
                self._grow()
                continue
            part, h = h[:room], h[room:]
            lost = part[~self.tables[-1].add(part)]
            if len(lost):
                self._grow()
                h = np.r_[lost, h]

    def remove(self, h: int) -> bool:
        return any(t.remove(h) for t in reversed(self.tables))

    def dumps(self) -> bytes:
        """The filter as bytes: sizes and fill of its tables, then their cells."""
        head = np.array([len(self.tables), *[x for t in self.tables for x in (len(t.cells).bit_length() - 1, t.n)]], np.int64)
        return head.tobytes() + b"".join(t.cells.tobytes() for t in self.tables)

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        head, at = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2), 8 * (2 * n + 1)
        out = cls(int(head[-1, 0]))
        out.tables = []
        for size, used in head.tolist():
            t = CuckooTable(size)
            t.cells = np.frombuffer(data, np.uint16, t.cells.size, at).reshape(-1, SLOTS).copy()
            t.n, at = used, at + t.cells.nbytes
            out.tables.append(t)
        return out

    def seen_then_add(self, h: np.ndarray) -> np.ndarray:
        """For hashes in order of arrival: what the filter says of each with the earlier ones of ``h`` in it. Hashes that it
        calls seen aren't added, so those of a filter filled this way mustn't be removed."""
        seen = self.has(h)
        todo = np.flatnonzero(~seen)
        while len(todo):
            table = self.tables[-1]
            if table.room() <= 0:
                self._grow()
                continue
            first = table.firsts(h[todo])[: table.room()]
            added = table.add(h[todo[first]])
            if not added.all():
                self._grow()
            rest = np.delete(todo, first[added])
            seen[rest] = table.has(h[rest])
            todo = rest[~seen[rest]]
        return seen


def _bucket(h: str | Column, bits: int) -> Column:
    """The leading bits of a hash."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def seen_before(arrivals: DataFrame, *, key: str, order: str, log2_buckets: int = 12, bucket_rows: int = BUCKET_ROWS, hot_rows: int | None = None) -> DataFrame:
    """(``order``, ``said``, ``raw``, ``repeat``): per arrival with a non-NULL key, what is said of it, what its filter said and
    what is true. A filter calls some new keys seen, which the exact check puts right. ``said`` and ``raw`` differ for heavy
    keys only: each filter they are spread over calls its first arrival new, and ``said`` has these put right.

    Arrivals are shuffled once, by the hash of their key, and pass the filter of their bucket in order of arrival. The exact
    check follows where they are: only arrivals whose hash a filter called seen have their keys compared, with those of the
    same bucket. A bucket has about ``bucket_rows`` rows whatever the data. Heavy keys are spread over tasks; what is true of
    them follows from their first arrivals, one row a key.

    ``order`` must be unique and not NULL; keys are compared byte for byte. Arrivals with a NULL key have no row. An empty
    input gives an empty result.
    """
    spark = arrivals.sparkSession
    rows = arrivals.where(F.col(key).isNotNull()).select(F.col(order).alias("__o"), F.col(key).alias("__k"), F.xxhash64(key).alias("__h"))
    heavy, total = heavy_keys(rows.select("__h"), "__h", hot_rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // PART_ROWS))
    bits = int(total // (parts * bucket_rows)).bit_length()
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    salt = F.lit(0)
    if heavy:
        hot = F.broadcast(spark.createDataFrame([(h,) for h in heavy], "__h bigint"))
        firsts = rows.join(hot, "__h").groupBy("__h", "__k").agg(F.min("__o").alias("__first"))  # one row a heavy key
        salts = int(max(heavy.values()) // (hot_rows or BUCKET_ROWS)) + 2
        rows = rows.join(F.broadcast(firsts), ["__h", "__k"], "left")
        salt = F.when(F.col("__first").isNotNull(), F.pmod(F.xxhash64("__o"), F.lit(salts))).otherwise(0)
    else:
        rows = rows.withColumn("__first", F.lit(None).cast(kind["__o"]))
    # the 16 leading bits are the fingerprint: buckets go by the bits behind them
    rows = rows.withColumn("__b", _bucket(F.shiftleft("__h", 16), bits)).repartition(parts, F.col("__h"), salt).sortWithinPartitions("__b", "__o").select("__b", "__o", "__k", "__h", "__first")

    def settle(bucket: pa.Table) -> pa.RecordBatch:
        h = bucket.column("__h").to_numpy().view(np.uint64)
        raw = CuckooFilter(log2_buckets).seen_then_add(h)
        repeat = np.zeros(len(h), bool)
        at = np.flatnonzero(np.isin(h, h[raw]))
        if len(at):
            code = bucket.column("__k").take(pa.array(at)).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            repeat[at] = True
            repeat[at[np.unique(code, return_index=True)[1]]] = False
        said = raw.copy()
        hot = np.flatnonzero(bucket.column("__first").is_valid().to_numpy())
        if len(hot):
            rest = bucket.take(pa.array(hot))
            repeat[hot] = pa.compute.greater(rest.column("__o"), rest.column("__first")).to_numpy()
            said[hot] |= repeat[hot]
        return pa.RecordBatch.from_arrays([bucket.column("__o").combine_chunks(), pa.array(said), pa.array(raw), pa.array(repeat)], [order, "said", "raw", "repeat"])

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            b = batch.column("__b").to_numpy()
            edges = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for start, end in zip(edges, edges[1:]):
                if held and end > start and held[0].column("__b")[0].as_py() != b[start]:
                    yield settle(pa.concat_tables(held))
                    held = []
                if end > start:
                    held.append(pa.Table.from_batches([batch.slice(start, end - start)]))
        if held:
            yield settle(pa.concat_tables(held))

    return rows.mapInArrow(by_bucket, f"`{order}` {kind['__o']}, said boolean, raw boolean, repeat boolean")


def audit(flags: DataFrame) -> DataFrame:
    """(``arrivals``, ``repeats``, ``wrong_answers``, ``missed``, ``share_wrong``, ``false_positive_rate``) of what seen_before
    gives: how often the filters themselves were wrong, how often of these they called a repeat new, which only happens to
    heavy keys, and the share of new arrivals that they called seen."""
    wrong, new = F.count_if(F.col("raw") != F.col("repeat")), F.count_if(~F.col("repeat"))
    return flags.agg(
        F.count(F.lit(1)).alias("arrivals"),
        F.count_if("repeat").alias("repeats"),
        wrong.alias("wrong_answers"),
        F.count_if(~F.col("raw") & F.col("repeat")).alias("missed"),
        (wrong / F.count(F.lit(1))).alias("share_wrong"),
        (F.count_if(F.col("raw") & ~F.col("repeat")) / new).alias("false_positive_rate"),
    )


# filters that are kept: (``bucket``, ``state``), one row a bucket


def update_filters(filters: DataFrame | None, keys: DataFrame, *, key: str, remove: bool = False, bits: int = 8, log2_buckets: int = 12) -> DataFrame:
    """Kept filters after ``keys`` were added, or with ``remove`` taken out; write them to keep them for the next run.

    Added are keys that aren't in yet, once each; only keys that were added may be removed. ``bits`` of the hash give the
    bucket, the same number as long as the filters live; a filter that is full gets a table twice as large. NULL keys are
    left out. Keys are reduced to different hashes before they are shuffled.
    """
    spark = keys.sparkSession
    old = filters if filters is not None else spark.createDataFrame([], "bucket int, state binary")
    new = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")).distinct().withColumn("bucket", _bucket("h", bits))

    def merge(state: pa.Table, hashes: pa.Table) -> pa.Table:
        held = CuckooFilter.loads(state.column("state")[0].as_py()) if state.num_rows else CuckooFilter(log2_buckets)
        h = hashes.column("h").to_numpy().view(np.uint64) if hashes.num_rows else np.zeros(0, np.uint64)
        if remove:
            for x in h[held.has(h)]:
                held.remove(x)
        else:
            held.add(h[~held.has(h)])  # also those that look alike, so that one can be taken out without the other
        bucket = (state if state.num_rows else hashes).column("bucket")[:1]
        return pa.table([bucket, pa.array([held.dumps()], pa.binary())], ["bucket", "state"])

    return old.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(merge, "bucket int, state binary")


def ask_filters(filters: DataFrame, arrivals: DataFrame, *, key: str, bits: int = 8) -> DataFrame:
    """Arrivals whose key the kept filters call seen: all of those that are in, and few others, which an exact check can drop.
    NULL keys are never seen."""
    asked = arrivals.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")).distinct().withColumn("bucket", _bucket("h", bits))

    def look(state: pa.Table, hashes: pa.Table) -> pa.Table:
        if not state.num_rows or not hashes.num_rows:
            return pa.table([pa.array([], pa.int64())], ["__h"])
        h = hashes.column("h").to_numpy()
        return pa.table([pa.array(h[CuckooFilter.loads(state.column("state")[0].as_py()).has(h.view(np.uint64))])], ["__h"])

    seen = filters.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(look, "__h bigint")
    return arrivals.join(seen, F.xxhash64(key) == F.col("__h"), "left_semi")
