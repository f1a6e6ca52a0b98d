"""Mixing sources to target weights: hierarchical budgets and seeded epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolake.session import materialize

RANGE_BITS = 12
#: Rows up to which a table of sources or leaves, counted before, is broadcast.
MAX_BROADCAST_ROWS = 100_000
LEAF = ["__src", "__l", "__none"]


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it is small; a larger one is joined by shuffles."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def _share_out(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """``children`` (``w``: weight, ``cap``: capacity, ``given``: their parent's budget) with ``budget``: what each gets.

    A parent's budget goes to its children by weight, but none gets more than its capacity; what is left over goes to its
    siblings by weight. In order of capacity a unit of weight, the first children are full and the others share the rest, so
    sums over that order settle it at once.
    """
    order = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), F.col(name).asc_nulls_first())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    left = F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    x = children.withColumn("__full", F.col("cap") * F.sum("w").over(after) <= left * F.col("w"))
    family = W.partitionBy(*parent)
    rest = F.col("given") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("cap"))).over(family), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("__full"), F.col("w"))).over(family)
    return x.withColumn("budget", F.when(F.col("__full"), F.col("cap")).otherwise(F.greatest(rest, F.lit(0.0)) * F.col("w") / open_)).drop("__full", "given")


def leaf_budgets(leaves: DataFrame, targets: DataFrame, tree: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """(``__src``, ``__l``, ``__none``, ``n``, ``repeats``, ``budget``): the tokens that each leaf (a source and a language, with
    ``n`` tokens) should give.

    Budgets go down a tree of domains (``tree``: source, domain; others are one domain), languages and sources. A source's
    share is spread over its languages by their tokens. A source without tokens is a leaf of no capacity in its domain: its
    share goes to the sources of that domain first. ``total`` defaults to the tokens of all leaves.
    """
    of = targets.select(F.col("source").alias("__src"), "share", "repeats")
    if tree is not None:
        of = of.join(tree.groupBy(F.col("source").alias("__src")).agg(F.min("domain").alias("domain")), "__src", "left").withColumn("domain", F.coalesce("domain", F.lit("other")))
    else:
        of = of.withColumn("domain", F.lit("other"))
    per_source = leaves.groupBy("__src").agg(F.sum("n").alias("tokens"))
    known = of.join(per_source, "__src", "left")
    full = known.where("tokens > 0").join(leaves.where("n > 0"), "__src")
    cols = ["domain", "__src", "__l", "__none", "n", "repeats"]
    full = full.select(*cols, (F.col("share") * F.col("n") / F.col("tokens")).alias("w"), (F.col("n") * F.col("repeats")).cast("double").alias("cap"))
    void = known.where(F.coalesce("tokens", F.lit(0)) == 0).select("domain", "__src", F.lit(None).cast("string").alias("__l"), F.lit(None).cast("boolean").alias("__none"), F.lit(0).cast("bigint").alias("n"), "repeats", F.col("share").cast("double").alias("w"), F.lit(0.0).alias("cap"))
    leaf = full.unionByName(void).withColumn("__lang", F.struct("__none", "__l"))
    langs = leaf.groupBy("domain", "__lang").agg(F.sum("w").alias("w"), F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("w").alias("w"), F.sum("cap").alias("cap")).withColumn("__root", F.lit(0))
    wanted = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).scalar() if total is None else F.lit(float(total))
    whole = F.sum("cap").over(W.partitionBy("__root"))
    domains = _share_out(domains.withColumn("given", F.least(wanted, whole)), ["__root"], "domain").select("domain", F.col("budget").alias("given"))
    langs = _share_out(langs.join(domains, "domain"), ["domain"], "__lang").select("domain", "__lang", F.col("budget").alias("given"))
    leaf = leaf.join(langs, (leaf["domain"] == langs["domain"]) & leaf["__lang"].eqNullSafe(langs["__lang"])).select(leaf["*"], "given")
    return _share_out(leaf, ["domain", "__lang"], "__src").where("n > 0").select(*LEAF, "n", "repeats", "budget")


def _listed(targets: DataFrame) -> DataFrame:
    """(``source``, ``share``, ``repeats``) of the rows of ``targets`` that count; of several for a source that with the greatest share."""
    t = targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("bigint").alias("repeats"))
    t = t.where("source is not null and share > 0 and repeats > 0")
    return t.groupBy("source").agg(F.max(F.struct("share", "repeats")).alias("x")).select("source", "x.share", "x.repeats")


def _records(sized: DataFrame, listed: DataFrame, record: str, source: str, lang: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """Records of listed sources, and the leaves they make with their tokens."""
    docs = sized.select(F.col(record).alias("__id"), F.col(source).alias("__src"), F.col(lang).alias("__lang"), F.coalesce(tokens, F.lit(0)).cast("bigint").alias("__n"))
    docs = docs.join(_small(listed.select(F.col("source").alias("__src"))), "__src").withColumn("__none", F.col("__lang").isNull()).withColumn("__l", F.coalesce("__lang", F.lit("")))
    return docs, docs.groupBy(*LEAF).agg(F.sum("__n").alias("n"))


def planned_shares(sized: DataFrame, targets: DataFrame, *, source: str = "source", lang: str = "lang", tokens: str = "n_tokens", tree: DataFrame | None = None, total_tokens: int | None = None) -> DataFrame:
    """(``source``, ``planned_share``): the share of the mix each source with records is to have, after shortages are made up."""
    listed = _listed(targets)
    _, leaves = _records(sized.withColumn("__rec", F.lit(0)), listed, "__rec", source, lang, tokens)
    b = leaf_budgets(materialize(leaves, "leaves"), listed, tree, total_tokens).groupBy(F.col("__src").alias("source")).agg(F.sum("budget").alias("b"))
    return b.select("source", (F.col("b") / F.sum("b").over(W.partitionBy(F.lit(0)))).alias("planned_share"))


def mix(
    sized: DataFrame,
    targets: DataFrame,
    *,
    record: str = "doc_id",
    source: str = "source",
    lang: str = "lang",
    tokens: str = "n_tokens",
    tree: DataFrame | None = None,
    total_tokens: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """(``record``, ``source``, ``lang``, ``tokens``, ``uses``, ``part_tokens``): how often each record is used whole, and how
    many of its first tokens are used once more; records that aren't used have no row.

    ``targets``: (source, target_share, max_repeats), one row a source; ``tree``: (source, domain). Budgets go down a tree of
    domains, languages and sources; a shortage is made up by siblings before ancestors. A leaf's budget is whole epochs of all its records and,
    of the last epoch, a prefix of their tokens in a seeded order: the record at the cut is used in part, so budgets are met
    to the token and no record is used more than ``max_repeats`` times, in part included. The cut is found by sums over
    4096 ranges of the order; records are sorted only inside the range of the cut.

    Records without a source or with one that isn't listed are left out; a NULL language is one of its own; NULL tokens
    count as 0. Rows of ``targets`` with a NULL share, a share of 0 or without repeats count as unlisted. No records or
    targets give an empty result. There may be any number of sources and languages; none are held by the driver.
    """
    listed = _listed(targets)
    docs, leaves = _records(sized, listed, record, source, lang, tokens)
    b = leaf_budgets(materialize(leaves, "leaves"), listed, tree, total_tokens)  # records are summed up once
    epochs = F.least(F.col("repeats"), F.floor(F.col("budget") * (1 + 1e-12) / F.col("n")))
    rest = F.when(epochs < F.col("repeats"), F.floor(F.round(F.col("budget") - epochs * F.col("n"), 3))).otherwise(0)
    leaf = materialize(b.select(*LEAF, epochs.cast("bigint").alias("__epochs"), F.greatest(rest, F.lit(0)).cast("bigint").alias("__rest")), "budgets")
    few = leaf.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    by_leaf = F.broadcast if few else (lambda df: df)

    docs = docs.join(by_leaf(leaf), LEAF).withColumn("__h", F.xxhash64(F.lit(seed), F.col("__epochs"), F.col("__id")))
    docs = docs.withColumn("__r", F.shiftrightunsigned("__h", 64 - RANGE_BITS).cast("int"))
    sums = docs.where("__rest > 0").groupBy(*LEAF, "__r", "__rest").agg(F.sum("__n").alias("s"))
    upto = W.partitionBy(*LEAF).orderBy("__r").rowsBetween(W.unboundedPreceding, 0)  # 4096 rows a leaf
    cut = sums.withColumn("c", F.sum("s").over(upto)).where("c > __rest")
    cut = cut.groupBy(*LEAF).agg(F.min("__r").alias("__cut"), F.min_by(F.col("c") - F.col("s"), "__r").alias("__before"))
    docs = docs.join(by_leaf(cut), LEAF, "left")
    taken = F.when((F.col("__rest") > 0) & (F.col("__cut").isNull() | (F.col("__r") < F.col("__cut"))), 1).otherwise(0)
    at_cut = (F.col("__r") == F.col("__cut")) & (F.col("__rest") > 0)
    sure = docs.where(~F.coalesce(at_cut, F.lit(False))).withColumn("uses", F.col("__epochs") + taken).withColumn("__part", F.lit(0))
    order = W.partitionBy(*LEAF).orderBy("__h", "__id").rowsBetween(W.unboundedPreceding, 0)
    edge = docs.where(at_cut).withColumn("__left", F.col("__rest") - F.col("__before") - F.sum("__n").over(order) + F.col("__n"))
    whole = F.col("__left") >= F.col("__n")
    edge = edge.withColumn("uses", F.col("__epochs") + F.when(whole, 1).otherwise(0)).withColumn("__part", F.when(whole, 0).otherwise(F.greatest("__left", F.lit(0))))
    out = [F.col("__id").alias(record), F.col("__src").alias(source), F.col("__lang").alias(lang), F.col("__n").alias(tokens), F.col("uses").cast("int").alias("uses"), F.col("__part").cast("bigint").alias("part_tokens")]
    return sure.select(*out).union(edge.select(*out)).where("uses > 0 or part_tokens > 0")


def reached_shares(mixed: DataFrame, targets: DataFrame, *, source: str = "source", tokens: str = "n_tokens") -> DataFrame:
    """(``source``, ``target_share``, ``max_repeats``, ``records``, ``mixed_tokens``, ``reached_share``): one row a target."""
    got = mixed.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("records"), F.sum(F.col(tokens) * F.col("uses") + F.col("part_tokens")).alias("mixed_tokens"))
    total = got.agg(F.sum("mixed_tokens")).scalar()
    t = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["records", "mixed_tokens"])
    return t.select("source", "target_share", "max_repeats", "records", "mixed_tokens", (F.col("mixed_tokens") / total).alias("reached_share"))
