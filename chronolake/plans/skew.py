"""Finding heavy keys from a sample of the scan and cutting them into shards of bounded size.

A key is heavy if it holds more than MAX_ROWS rows, whatever the table has, or more than one in SHARE of its rows, MIN_ROWS
at least. Heavy keys and the times that cut them come from one look at every tenth piece of the scan, at most SAMPLE_ROWS
rows of them. Results never depend on the sample: where it misleads, shards are of less equal size, but hold at most what a
heavy key has in the ten pieces around one that was read.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

MIN_ROWS, MAX_ROWS, SHARE = 4_096, 1_000_000, 256
#: Sampled rows in all, and of one piece.
SAMPLE_ROWS, PIECE_ROWS = 1 << 21, 1 << 18
#: Sampled rows a shard must have, so that its bounds are worth something.
LEAST_SEEN = 10
#: Bytes below which a frame isn't worth a look: no key of it can be heavy.
SMALL = 2 << 20


@dataclass
class Bounds:
    """Heavy keys. ``frame``: (key, ``__bounds``: different ascending times that cut it into shards, ``__starts``: how many bounds
    lie before each and in all, as one may be repeated, ``__last``: the last shard); ``rows``: what each key holds, about."""

    frame: DataFrame
    rows: dict


def plan_bytes(df: DataFrame) -> int:
    """What Spark expects a frame to take, from file sizes and columns; nothing is read."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _reservoir(most: int, columns: list[str]):
    """One row a piece: how many rows it has and ``most`` of them, drawn evenly."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, n, held, luck = np.random.default_rng(7), 0, None, np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            n += batch.num_rows
            new = pa.table(batch.columns, columns)
            held = new if held is None else pa.concat_tables([held, new])
            luck = np.concatenate([luck, rng.random(batch.num_rows)])
            if len(luck) > 2 * most:
                keep = np.sort(np.argpartition(luck, most)[:most])
                held, luck = held.take(pa.array(keep)).combine_chunks(), luck[keep]
        if held is None:
            return
        if len(luck) > most:
            held = held.take(pa.array(np.sort(np.argpartition(luck, most)[:most])))
        yield _packed(n, held)

    return draw


def _bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _packed(n: int, rows: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([_bytes(rows)], pa.binary())], ["n", "rows"])


def _thinned(n: int, rows: bytes, most: int) -> tuple[int, bytes]:
    """At most ``most`` of a piece's rows."""
    held = pa.ipc.open_stream(bytes(rows)).read_all()
    if held.num_rows <= most:
        return n, bytes(rows)
    return n, _bytes(held.take(pa.array(np.sort(np.random.default_rng(7).choice(held.num_rows, most, False)))))


class Look:
    """A look at some pieces of a frame's scan. ``rows``: rows of every tenth piece, or None; ``piece``: which of them each is
    from; ``weight``: how many rows of its piece it stands for; ``share``: how many pieces each of these stands for; ``total``:
    about how many rows the frame has. More pieces are taken where these hold next to nothing; others aren't read."""

    def __init__(self, df: DataFrame) -> None:
        drawn = df.mapInArrow(_reservoir(PIECE_ROWS, df.columns), "n bigint, rows binary").rdd
        pieces, taken, found = drawn.getNumPartitions(), 0, []
        order = [p for first in random.Random(11).sample(range(10), 10) for p in range(first, pieces, 10)]
        step = max(2, pieces // 10)
        most = max(1000, SAMPLE_ROWS // step)
        while taken < pieces and sum(n for n, _ in found) < 1000:
            got = df.sparkSession.sparkContext.runJob(drawn, lambda it: [_thinned(*r, most) for r in it], order[taken : taken + step])
            found += [(n, pa.ipc.open_stream(b).read_all()) for n, b in got]
            taken, step = min(pieces, taken + step), 2 * step
        self.share = pieces / max(1, taken)
        self.total = self.share * sum(n for n, _ in found)
        self.rows = pa.concat_tables([t for _, t in found]) if found else None
        self.piece = np.repeat(np.arange(len(found)), [t.num_rows for _, t in found])
        self.weight = np.concatenate([np.full(t.num_rows, n / max(1, t.num_rows)) for n, t in found]) if found else np.zeros(0)


def _between(times: pa.Table, weight: np.ndarray, piece: np.ndarray, share: float, most: int) -> tuple[pa.Table, np.ndarray]:
    """``times`` and ``weight`` with points for the pieces that weren't read, where a table lies in order of time: spread evenly
    over the stretches that lie between the times of the pieces read (of several columns, the first that isn't the same for all). Only for numbers, dates and timestamps; where pieces
    overlap in time there are none, and those read speak for the others."""
    at = next((i for i in range(times.num_columns) if pc.count_distinct(times.column(i), mode="all").as_py() > 1), 0)  # what comes before is the same for all
    t0 = times.column(at).combine_chunks()
    if share <= 1 or not (pa.types.is_integer(t0.type) or pa.types.is_floating(t0.type) or pa.types.is_temporal(t0.type)):
        return times, weight
    plain = t0 if not pa.types.is_temporal(t0.type) else t0.cast(pa.int32() if pa.types.is_date32(t0.type) else pa.int64())
    known = plain.is_valid().to_numpy(zero_copy_only=False)
    x, piece = plain.fill_null(0).to_numpy(zero_copy_only=False)[known], piece[known]
    ids = np.unique(piece)
    low, high = (np.array([f(x[piece == p]) for p in ids]) for f in (np.min, np.max))
    order = np.argsort(low, kind="stable")
    reach = np.maximum.accumulate(high[order])
    open_ = np.flatnonzero(low[order][1:] > reach[:-1])
    if not len(open_):
        return times, weight
    missing = (share - 1) * weight.sum() / len(ids)
    n = int(max(1, min(1000, -(-missing // most) * 4)))
    new = [np.linspace(reach[i], low[order][i + 1], n + 2)[1:-1] for i in open_]
    if 2 * len(open_) >= len(ids) - 1:  # it does lie in order: go on beyond the first and the last piece read
        beyond = share * np.mean(high - low)
        new += [np.linspace(low.min() - beyond, low.min(), n + 1)[:-1], np.linspace(reach[-1], reach[-1] + beyond, n + 1)[1:]]
    if pa.types.is_temporal(t0.type):  # years 1 to 9999
        limits = (-719_162, 2_932_896) if pa.types.is_date32(t0.type) else (-62_135_596_800e6, 253_402_300_799e6)
    else:
        limits = (-np.inf, np.inf) if pa.types.is_floating(t0.type) else tuple((0.99 if t0.type.bit_width == 64 else 1) * x for x in (np.iinfo(t0.type.to_pandas_dtype()).min, np.iinfo(t0.type.to_pandas_dtype()).max))
    new = np.clip(np.concatenate(new), *limits)
    values = pa.array(new if pa.types.is_floating(plain.type) else new.astype(np.int64)).cast(plain.type).cast(t0.type)
    one = [pa.array([times.column(i)[0].as_py()] * len(new), times.schema.field(i).type) for i in range(at)]
    more = pa.table([*one, values, *[pa.nulls(len(new), times.schema.field(i).type) for i in range(at + 1, times.num_columns)]], schema=times.schema)
    return pa.concat_tables([times, more]), np.r_[weight, np.full(len(new), missing / n)]


def task_rows(total: float) -> int:
    """How many rows of one key a task should take at most, of a table with ``total`` rows."""
    return int(min(MAX_ROWS, max(MIN_ROWS, total / SHARE)))


def time_bounds(df: DataFrame, key: str, time: str | Sequence[str], hot_rows: int | None = None) -> Bounds | None:
    """Heavy keys of ``df`` and the values of ``time`` that cut the rows of each into shards of about ``hot_rows`` (by default
    what a task should take). A value that many rows share is repeated. Several columns give bounds that are structs of them.
    None without heavy keys; NULL is none.

    A frame that Spark expects to take no more than SMALL bytes has no heavy keys and isn't looked at.
    """
    return _find(df, key, [time] if isinstance(time, str) else list(time), isinstance(time, str), hot_rows)[1]


def _find(df: DataFrame, key: str, names: list[str], plain: bool, hot_rows: int | None) -> tuple[float, Bounds | None]:
    if hot_rows is None and plan_bytes(df) <= SMALL:
        return SMALL / 8, None
    by = [f"t{i}" for i in range(len(names))]
    look = Look(df.select(F.col(key).alias("k"), *[F.col(c).alias(t) for c, t in zip(names, by)]))
    if look.rows is None:
        return 0.0, None
    most = hot_rows or task_rows(look.total)
    codes = look.rows.column("k").combine_chunks().dictionary_encode()
    code = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    weights = look.share * np.bincount(code + 1, look.weight, len(codes.dictionary) + 1)[1:]
    counts = np.bincount(code + 1, minlength=len(codes.dictionary) + 1)[1:]
    heavy = np.flatnonzero((weights > most) & (counts >= 2 * LEAST_SEEN))
    if not len(heavy):
        return look.total, None
    keys = codes.dictionary.take(pa.array(heavy))
    held = {value: float(weights[c]) for c, value in zip(heavy, keys.to_pylist())}
    out = []
    for c, value in zip(heavy, held):
        shards = int(max(2, min(-(-weights[c] // most), counts[c] // LEAST_SEEN)))
        cuts: list = []
        if names:
            at = np.flatnonzero(code == c)
            times, weight = _between(look.rows.select(by).take(pa.array(at)), look.weight[at], look.piece[at], look.share, most)
            by_time = pc.sort_indices(times, sort_keys=[(t, "ascending") for t in by], null_placement="at_start").to_numpy()
            upto = np.cumsum(weight[by_time])
            cut = by_time[np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards), len(upto) - 1)]
            bounds = times.take(pa.array(cut)).to_pylist()
            cuts = [b["t0"] for b in bounds if b["t0"] is not None] if plain else [tuple(b.values()) for b in bounds]
        times_each = Counter(cuts)  # in the order of the cuts, which are sorted
        out.append((value, [*times_each], [0, *accumulate(times_each.values())], len(cuts)))
    kinds = [df.schema[c].dataType for c in names]
    bound = kinds[0] if plain else T.StructType([T.StructField(t, k) for t, k in zip(by, kinds)])
    arrays = [T.StructField("__bounds", T.ArrayType(bound, False)), T.StructField("__starts", T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *arrays, T.StructField("__last", T.IntegerType())])
    return look.total, Bounds(df.sparkSession.createDataFrame(out, schema), held)


def heavy_keys(df: DataFrame, key: str, hot_rows: int | None = None) -> tuple[dict, float]:
    """{key: about how many rows} of the heavy keys, and about how many rows ``df`` has, at most."""
    total, found = _find(df.select(key), key, [], False, hot_rows)
    return found.rows if found else {}, total


def _shard(value: Column, again: Column) -> Column:
    """The shard of ``value`` by the columns of Bounds: behind all bounds below it, ``again`` of those that are equal."""
    at = InternalFunction.array_binary_search(F.col("__bounds"), value)
    shard = F.when(at >= 0, F.get("__starts", at) + again).otherwise(F.get("__starts", -at - 1))
    return F.when(F.col("__last").isNull(), 0).otherwise(F.coalesce(shard, F.lit(0))).cast("int")


def first_shard(value: Column) -> Column:
    """The shard of ``value``, the first one if a repeated bound spreads it over several; 0 for light keys and NULL."""
    return _shard(value, F.lit(1))


def spread_shard(value: Column, salt: Column) -> Column:
    """Like first_shard, but rows of one repeated bound are spread over all of its shards by ``salt``."""
    at = InternalFunction.array_binary_search(F.col("__bounds"), value)
    return _shard(value, 1 + F.pmod(salt, F.get("__starts", at + 1) - F.get("__starts", at)))


def with_shards(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` with ``__shard`` and ``__hot``, and whether any key is heavy. Shards of a key follow each other in ``order``
    (NULLs come first), so many rows at one time are cut by what orders them there. Without ``keys`` the whole table is one key."""
    rows = df.withColumn("__kh", F.xxhash64(*keys) if keys else F.lit(0).cast("long"))
    bounds = time_bounds(rows.select("__kh", *order), "__kh", list(order), hot_rows)
    if bounds is None:
        return rows.withColumn("__shard", F.lit(0)).withColumn("__hot", F.lit(False)).drop("__kh"), False
    value = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(order)])
    rows = rows.join(F.broadcast(bounds.frame), "__kh", "left").withColumn("__shard", first_shard(value))
    return rows.withColumn("__hot", F.col("__last").isNotNull()).drop("__bounds", "__starts", "__last", "__kh"), True
