"""Change logs in time: history, as-of reads and the latest state.

A log has a key ``k``, a time ``tx`` and a value ``v`` (NULL: deleted), at most one row a key and time. A history has the
value before each change as ``prev`` (NULL: the key did not exist). "As of T" is the state before T, ranges are [from, to).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolake.operators import index as ix
from chronolake.operators.asof import as_known_at
from chronolake.operators.ordered import neighbour


def history(log: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(``k``, ``tx``, ``v``, ``prev``): each change with the value before it."""
    return neighbour(log.select("k", "tx", "v"), keys=["k"], time="tx", take={"prev": "v"}, hot_rows=hot_rows)


def changes_only(log: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """The log without rows that change nothing: equal to the value before, or deletions of what isn't there."""
    return history(log, hot_rows).where(~F.col("v").eqNullSafe(F.col("prev"))).select("k", "tx", "v", "prev")


def _between(df: DataFrame, start, end) -> DataFrame:
    if start is not None:
        df = df.where(F.col("tx") >= start)
    return df if end is None else df.where(F.col("tx") < end)


def latest(log: DataFrame, deleted: bool = False) -> DataFrame:
    """(``k``, ``v``): the last value of each key; deleted keys only on request."""
    state = log.groupBy("k").agg(F.max(F.struct("tx", "v")).alias("x")).select("k", F.col("x.v").alias("v"))
    return state if deleted else state.where("v is not null")


def as_of(log: DataFrame, at: int) -> DataFrame:
    """(``k``, ``v``): the state before ``at``. The filter on time reaches the scan, keys are reduced before the shuffle."""
    return latest(log.where(F.col("tx") < at))


def as_of_by_history(hist: DataFrame, at: int) -> DataFrame:
    """The same from a history and its latest values: the value before the first change from ``at`` on, else the latest.
    Whether a later change was found is kept apart from a NULL it holds."""
    first = F.min(F.when(F.col("tx") >= at, F.struct("tx", "prev"))).alias("h")
    x = hist.groupBy("k").agg(F.max(F.struct("tx", "v")).alias("l"), first)
    return x.select("k", F.when(F.col("h").isNotNull(), F.col("h.prev")).otherwise(F.col("l.v")).alias("v")).where("v is not null")


def get_no_state(hist: DataFrame, probes: DataFrame) -> DataFrame:
    """(``k``, ``at``, ``found``, ``v``) for different probes (k, at): the value before the key's first change at or after
    ``at``; not found if there is none."""
    p = probes.select("k", "at").distinct().withColumn("__when", -F.col("at"))
    h = hist.select("k", (-F.col("tx")).alias("__tx"), "prev")
    got = as_known_at(p, h, key="k", event_time="__when", order=["__tx"], available=["__tx"], payload=["prev"], how="left")
    return got.select("k", "at", F.col("__tx").isNotNull().alias("found"), F.col("prev").alias("v"))


def history_range(hist: DataFrame, start=None, end=None, limit: int = -1) -> DataFrame:
    """(``k``, ``v``): keys changed in [start, end) with the value before the first such change, NULL if there was none."""
    found = _between(hist, start, end).groupBy("k").agg(F.min(F.struct("tx", "prev")).alias("h")).select("k", F.col("h.prev").alias("v"))
    return found.orderBy("k").limit(limit) if limit >= 0 else found


def walk_as_of(hist: DataFrame, at: int, low=None, high=None, limit: int = -1) -> DataFrame:
    """(``k``, ``v``) as of ``at`` for the keys in [low, high) that change later."""
    if low is not None:
        hist = hist.where(F.col("k") >= low)
    if high is not None:
        hist = hist.where(F.col("k") < high)
    return history_range(hist, at, None, limit)


def history_index(hist: DataFrame, keys: DataFrame, start=None, end=None) -> DataFrame:
    """(``k``, ``tx``): when the given keys changed."""
    return _between(hist, start, end).select("k", "tx").distinct().join(keys.select("k"), "k", "left_semi")


def by_step(hist: DataFrame, step: int) -> DataFrame:
    """(``step``, ``k``, ``n``, ``max_tx``, ``before``): each key's changes in a step and its value before the first."""
    s = F.floor(F.col("tx") / step).cast("bigint").alias("step")
    x = hist.groupBy(s, "k").agg(F.count(F.lit(1)).alias("n"), F.max("tx").alias("max_tx"), F.min(F.struct("tx", "prev")).alias("h"))
    return x.select("step", "k", "n", "max_tx", F.col("h.prev").alias("before"))


def available_from(log: DataFrame) -> DataFrame:
    """(``first_tx``): where the data begin; the greatest 64-bit number if there are none."""
    return log.agg(F.coalesce(F.min("tx"), F.lit(2**63 - 1)).cast("bigint").alias("first_tx"))


def truncate(log: DataFrame, at: int) -> DataFrame:
    """The log before ``at``."""
    return log.where(F.col("tx") < at)


def delete_prefix(log: DataFrame, at: int, prefix: str) -> DataFrame:
    """Rows that delete every text key with this prefix that lives as of ``at``: a cascade."""
    living = as_of(log.where(F.col("k").startswith(prefix)), at)
    return living.select("k", F.lit(at).cast(log.schema["tx"].dataType).alias("tx"), F.lit(None).cast(log.schema["v"].dataType).alias("v"))


def add_prev(hist: DataFrame, changes: DataFrame) -> DataFrame:
    """The history with later changes (``k``, ``tx``, ``v``): the first of each key gets the last value of the history as its
    value before."""
    last = hist.groupBy("k").agg(F.max(F.struct("tx", "v")).alias("x")).select("k", F.col("x.v").alias("__last"))
    new = history(changes).join(last, "k", "left")
    first = F.col("tx") == F.min("tx").over(W.partitionBy("k"))
    return hist.select("k", "tx", "v", "prev").unionByName(new.select("k", "tx", "v", F.when(first, F.col("__last")).otherwise(F.col("prev")).alias("prev")))


class Writes:
    """Writes to several domains, a frame each, and to indexes of what happened; times are those of the writer.

    Domains hold text keys; a key of ``child`` begins with the key of ``parent`` it belongs to."""

    def __init__(self, domains: dict[str, DataFrame], index: DataFrame, *, parent: str, child: str) -> None:
        self.domains, self.index, self.parent, self.child = dict(domains), index, parent, child

    def update(self, domain: str, rows: DataFrame) -> None:
        """Appends (``k``, ``tx``, ``v``)."""
        self.domains[domain] = self.domains[domain].unionByName(rows.select("k", "tx", "v"))

    def delete(self, rows: DataFrame) -> None:
        """Deletes keys (``k``, ``tx``) of the parent domain, and with them those of the child domain that live and begin so."""
        gone = rows.select("k", "tx").distinct()
        self.update(self.parent, gone.withColumn("v", F.lit(None).cast(self.domains[self.parent].schema["v"].dataType)))
        log = self.domains[self.child]
        size = [r[0] for r in gone.select(F.length("k")).distinct().limit(1001).collect()]
        if len(size) > 1000:
            raise ValueError("keys of more than 1000 lengths")
        owner = log.select("*", F.explode(F.array(*[F.when(F.length("k") >= n, F.substring("k", 1, n)) for n in size])).alias("__owner")) if size else log.limit(0).withColumn("__owner", F.col("k"))
        before = owner.join(gone.select(F.col("k").alias("__owner"), F.col("tx").alias("__at")), "__owner").where(F.col("tx") < F.col("__at"))
        living = before.groupBy("k", "__at").agg(F.max(F.struct("tx", "v")).alias("x")).where("x.v is not null")
        self.update(self.child, living.select("k", F.col("__at").alias("tx"), F.lit(None).cast(log.schema["v"].dataType).alias("v")))

    def add(self, name: str, rows: DataFrame) -> None:
        """Adds (``k``, ``tx``) to an index."""
        self.index = ix.put(self.index, rows.select(F.lit(name).alias("name"), "k", "tx"))


# blocks: (block, max_tx), one row a block


def append_blocks(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """The blocks with new ones behind the last, without a gap; an error when read if one is missing or there already."""
    last = blocks.agg(F.max("block")).scalar()
    checked = neighbour(new.select("block", "max_tx"), keys=[], time="block", take={"before": "block"})
    expected = F.coalesce("before", last) + 1
    fits = F.when(expected.isNull() | (F.col("block") == expected), F.col("block"))
    bad = F.raise_error(F.concat(F.lit("block out of order: "), F.col("block").cast("string")))
    return blocks.select("block", "max_tx").unionByName(checked.select(F.coalesce(fits, bad).cast(blocks.schema["block"].dataType).alias("block"), "max_tx"))


def truncate_blocks(blocks: DataFrame, at: int) -> DataFrame:
    """Blocks before ``at``."""
    return blocks.where(F.col("block") < at)


def first_last_block(blocks: DataFrame) -> DataFrame:
    """(``first``, ``first_tx``, ``last``, ``last_tx``); NULLs without blocks."""
    ends = blocks.agg(F.min(F.struct("block", "max_tx")).alias("a"), F.max(F.struct("block", "max_tx")).alias("z"))
    return ends.select(F.col("a.block").alias("first"), F.col("a.max_tx").alias("first_tx"), F.col("z.block").alias("last"), F.col("z.max_tx").alias("last_tx"))


def block_bounds(blocks: DataFrame) -> DataFrame:
    """(``block``, ``min_tx``, ``max_tx``): the first block begins at 0, others after the one before."""
    x = neighbour(blocks.select("block", "max_tx"), keys=[], time="block", take={"before": "max_tx"})
    return x.select("block", F.coalesce(F.col("before") + 1, F.lit(0)).cast("bigint").alias("min_tx"), "max_tx")


def block_of(txs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(``tx``, ``block``) for different times: the first block whose last time isn't before it."""
    t = blocks.select(F.lit(0).alias("__one"), (-F.col("max_tx")).alias("__at"), (-F.col("block")).alias("__nb"), "block")
    p = txs.select("tx").distinct().select(F.lit(0).alias("__one"), (-F.col("tx")).alias("__when"), "tx")
    return as_known_at(p, t, key="__one", event_time="__when", order=["__at", "__nb"], available=["__at"], payload=["block"]).select("tx", "block")


def block_gaps(blocks: DataFrame) -> DataFrame:
    """(``block``, ``before``): blocks that don't follow the one before."""
    x = neighbour(blocks.select("block"), keys=[], time="block", take={"before": "block"})
    return x.where(F.col("before").isNotNull() & (F.col("block") != F.col("before") + 1))


class TemporalFrame:
    """A change log with the temporal reads as methods. ``key``, ``tx`` and ``value`` name its columns."""

    def __init__(self, log: DataFrame, key: str, tx: str, value: str) -> None:
        self.log = log.select(F.col(key).alias("k"), F.col(tx).alias("tx"), F.col(value).alias("v")).where("k is not null and tx is not null")

    def history(self) -> DataFrame:
        return history(self.log)

    def domain_get(self) -> DataFrame:
        return latest(self.log)

    def domain_get_as_of(self, at: int) -> DataFrame:
        return as_of(self.log, at)

    def history_get(self, probes: DataFrame) -> DataFrame:
        return get_no_state(self.history(), probes)

    def index_range(self, keys: DataFrame, start=None, end=None) -> DataFrame:
        return history_index(self.log, keys, start, end)

    def history_range(self, start=None, end=None, limit: int = -1) -> DataFrame:
        return history_range(self.history(), start, end, limit)

    def domain_range(self, at: int, low=None, high=None, limit: int = -1) -> DataFrame:
        state = as_of(self.log, at)
        if low is not None:
            state = state.where(F.col("k") >= low)
        if high is not None:
            state = state.where(F.col("k") < high)
        return state.orderBy("k").limit(limit) if limit >= 0 else state
