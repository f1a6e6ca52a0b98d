"""Queries p7 to p9 over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm.contamination import leaked_items
from chronolake.llm.mix import mix, planned_shares, reached_shares
from chronolake.llm.split import split_oversized
from chronolake.llm.tokens import count_tokens
from chronolake.plans.registry import Registry
from chronolake.session import materialize, spread, table

llm = Registry()

#: The file of the public tokenizer that these queries count with.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Sources and their domains in the tree of budgets, a table of these data.
DOMAINS = [
    ("lists_archive", "public"),
    ("newsletter_dump", "public"),
    ("helpdesk_export", "office"),
    ("legal_hold", "office"),
    ("board_minutes", "office"),
    ("field_notes", "office"),
    ("personal_mbox", "personal"),
    ("voicemail_notes", "personal"),
    ("bounce_spool", "machine"),
]


@llm.query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@llm.query("p7_items")
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents it leaked into."""
    items = table(spark, sf_dir, "eval_items")
    found = leaked_items(table(spark, sf_dir, "documents"), items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.select("item_id", "suite").join(found, "item_id", "left").na.fill(0, ["documents"])


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "mix_targets").select("source"), "source", "left_semi")
    return materialize(spread(listed.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", count_tokens(F.col("text"), TOKENIZER).alias("n_tokens")), "sized")


def _tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAINS, "source string, domain string")


@llm.query("p8_mix")
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"), tree=_tree(spark))


@llm.query("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source. What a source without enough tokens leaves goes to its domain first, so reached
    shares depend on the tree; ``flat_share`` is what the source would get if all sources were one domain."""
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    flat = planned_shares(sized, targets).withColumnRenamed("planned_share", "flat_share")
    return reached_shares(mix(sized, targets, tree=_tree(spark)), targets).join(flat, "source", "left").na.fill(0.0, ["flat_share"])


@llm.query("p8_within_caps", "SELECT source, target_share, max_repeats, true AS within_cap FROM mix_targets")
def p8_within_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether no record of a source is used more often than it may be, in part included."""
    used = p8_mix(spark, sf_dir).groupBy("source").agg(F.max(F.col("uses") + (F.col("part_tokens") > 0).cast("int")).alias("most"))
    t = table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats").join(used, "source", "left")
    return t.select("source", "target_share", "max_repeats", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"))


@llm.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "documents"), path=TOKENIZER, with_text=False).where("piece_no = 0").select("doc_id")


@llm.query("p9_pieces")
def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "documents"), path=TOKENIZER)
