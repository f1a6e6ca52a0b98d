"""Word files and their indexes: dictionaries, predicates on words, ordinal and offset lookups, longest matches."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.operators.ordered import global_rank, neighbour, running
from chronolake.session import materialize

DICTIONARY_SIZE = 65_536
#: Characters of the patterns that one automaton takes.
BLOCK_CHARS = 16 << 20
SHORTEST_PATTERN, LONGEST_PATTERN = 5, 128
IN_BUCKET = 2


def write_words(words: DataFrame, path: str) -> None:
    """A word file: (``n``, ``word``), sorted by position, dictionary-encoded and compressed."""
    words.repartitionByRange("n").sortWithinPartitions("n").write.option("compression", "zstd").parquet(path)


def read_words(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Words from a position on; earlier row groups are skipped by their footers."""
    df = spark.read.parquet(path)
    return df if first is None else df.where(F.col("n") >= first)


def word_scores(texts: DataFrame, text: str) -> DataFrame:
    """(``word``, ``score``): how often each space-separated word occurs, times its length. Words are counted where their
    text is before they are shuffled."""
    words = texts.select(F.explode(F.split(text, " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg((F.count(F.lit(1)) * F.max(F.length("word"))).cast("bigint").alias("score"))


def _common(a: Column, b: Column, most: int) -> Column:
    """How many characters two texts have in common from their begin, up to ``most``: a binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    room = F.least(F.length(a), F.length(b), F.lit(most))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= room) & (F.substring(a, 1, n + s) == F.substring(b, 1, n + s)), n + s).otherwise(n))


def suffix_array(texts: DataFrame, text_id: str, text: str, depth: int = LONGEST_PATTERN) -> DataFrame:
    """(``rank``, ``text_id``, ``pos``, ``lcp``): the suffixes of all texts in order, from rank 0, and how many characters each has
    in common with the one before (NULL for the first).

    Suffixes are compared to ``depth`` characters, what longer ones have in common is cut there, and equal ones follow by
    text and position; so a suffix is a row of bounded size and all of them are sorted over the cluster. ``text_id`` must be
    unique; ``pos`` is from 0. NULL and empty texts have no suffixes.
    """
    at = F.explode(F.sequence(F.lit(0), F.length(text) - 1)).alias("pos")
    cut = texts.where(F.length(text) > 0).select(F.col(text_id).alias("__id"), F.col(text).alias("__t"), at)
    cut = cut.select("__id", "pos", F.col("__t").substr(F.col("pos") + 1, F.lit(depth)).alias("__s"))
    r = global_rank(cut, order="__s", ties=["__id", "pos"])
    r = neighbour(r, keys=[], time="rank", take={"__p": "__s"})
    return r.select("rank", F.col("__id").alias(text_id), "pos", F.when(F.col("__p").isNotNull(), _common(F.col("__s"), F.col("__p"), depth)).alias("lcp"))


def frequent_substrings(texts: DataFrame, text: str, shortest: int, longest: int, least: int = 2) -> DataFrame:
    """(``pattern``, ``n``, ``score``): substrings of ``shortest`` to ``longest`` characters that occur ``least`` times or more;
    the score is what replacing all but one would save.

    Lengths are taken level by level of doubling: only positions whose first characters occur often enough are looked at for
    longer ones, so what occurs once is dropped at its shortest length. NULL and short texts have no substrings.
    """
    at = F.explode(F.sequence(F.lit(1), F.length(text) - shortest + 1)).alias("at")
    places = texts.where(F.length(text) >= shortest).select(at, F.col(text).alias("t"))
    found, low = None, shortest
    while low <= longest:
        high = min(longest, 2 * low - 1)
        head = F.substring("t", F.col("at"), F.lit(low))
        often = places.groupBy(head.alias("h")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("h")
        places = materialize(places.join(often, head == F.col("h"), "left_semi"), "places")
        lengths = F.sequence(F.lit(low), F.least(F.length("t") - F.col("at") + 1, F.lit(high)))
        n = places.select("t", "at", F.explode(lengths).alias("len")).groupBy(F.substring("t", F.col("at"), F.col("len")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
        part = n.where(F.col("n") >= least)
        found = part if found is None else found.union(part)
        low = high + 1
        places = places.where(F.length("t") - F.col("at") + 1 >= low)
        if places.isEmpty():
            break
    return found.withColumn("score", ((F.col("n") - 1) * F.length("pattern")).cast("bigint"))


def cover(texts: DataFrame, dictionary: DataFrame, *, text_id: str, text: str, word: str = "word") -> DataFrame:
    """(``text_id``, ``cost``, ``pieces``): each text as dictionary words and single characters, of least cost: a word costs 2, a
    character 1 (the length of a reference and of a literal). ``pieces`` holds the words and characters in order.

    Positions are settled from left to right, by all words that end there, so time grows with the text and its matches. The
    dictionary has at most DICTIONARY_SIZE words (more are an error). NULL texts have no row, empty ones no pieces.
    """
    words = [r[0] for r in dictionary.select(word).where(F.length(word) > 2).distinct().limit(DICTIONARY_SIZE + 1).collect()]
    if len(words) > DICTIONARY_SIZE:
        raise ValueError(f"more than {DICTIONARY_SIZE} words")
    kind = texts.schema[text_id].dataType.simpleString()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, len(w))
        if words:
            automaton.make_automaton()
        for batch in batches:
            ids, costs, pieces = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                ends: dict[int, list[int]] = {}
                for last, size in automaton.iter(t) if words and t else ():
                    ends.setdefault(last + 1, []).append(size)
                cost, taken = [0], [0]
                for at in range(1, len(t) + 1):
                    best, size = cost[at - 1] + 1, 1
                    for n in ends.get(at, ()):
                        if cost[at - n] + 2 < best:
                            best, size = cost[at - n] + 2, n
                    cost.append(best)
                    taken.append(size)
                cut, at = [], len(t)
                while at:
                    cut.append(t[at - taken[at] : at])
                    at -= taken[at]
                ids.append(i)
                costs.append(cost[-1])
                pieces.append(cut[::-1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(costs, pa.int32()), pa.array(pieces, pa.list_(pa.string()))], [text_id, "cost", "pieces"])

    return texts.where(F.col(text).isNotNull()).select(text_id, text).mapInArrow(settle, f"`{text_id}` {kind}, cost int, pieces array<string>")


def code_lengths(counts: dict) -> dict:
    """Bits of each symbol in an optimal prefix code for ``counts``; a lone symbol has one bit."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0]))))]
    bits = dict.fromkeys(counts, 0)
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a, *b):
            bits[s] += 1
        heapq.heappush(heap, (n + m, serial, [*a, *b]))
        serial += 1
    return {s: max(1, n) for s, n in bits.items()}


def build_dictionary(scores: DataFrame, most: int = DICTIONARY_SIZE) -> DataFrame:
    """The ``most`` words of the highest scores; of equal scores the greater words."""
    return scores.orderBy(F.desc("score"), F.desc("word")).limit(most)


def compare(word: Column, other: Column) -> Column:
    """-1, 0 or 1 as a word is less than, equal to or greater than the other, byte by byte."""
    return F.when(word < other, -1).when(word == other, 0).otherwise(F.when(word > other, 1))


def compare_prefix(word: Column, prefix: str) -> Column:
    """Like compare, but a word that starts with the prefix is equal."""
    return F.when(word.startswith(prefix), 0).otherwise(compare(word, F.lit(prefix)))


def word_stats(words: DataFrame, word: str) -> DataFrame:
    """(``n``, ``empty``, ``bytes``): words, empty ones and their length."""
    return words.agg(F.count(word).alias("n"), F.count_if(F.col(word) == "").alias("empty"), F.coalesce(F.sum(F.octet_length(word)), F.lit(0)).alias("bytes"))


def offset_index(entries: DataFrame, size: str) -> DataFrame:
    """(``k``, ``ordinal``, ``start``): where each key's entry begins in a file in key order, and its number. Keys must be
    whole numbers; a repeated one is an error when the index is read."""
    r = running(entries, keys=[], time="k", sums={"__end": size})
    twice = r.groupBy("k").agg(F.count(F.lit(1)).alias("__c"), F.min("rank").alias("rank"), F.min(F.col("__end") - F.col(size)).alias("start"))
    k = F.when(F.col("__c") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col("k").cast("string")))).otherwise(F.col("k")).cast(entries.schema["k"].dataType)
    return twice.select(k.alias("k"), (F.col("rank") - 1).alias("ordinal"), "start")


def _slot(key: str, seed: str, size: str) -> Column:
    return F.pmod(F.xxhash64(key, seed), F.col(size)).cast("int")


def perfect_hash(keys: DataFrame, key: str) -> DataFrame:
    """(``bucket``, ``first``, ``size``, ``seed``): a minimal perfect hash of different non-NULL keys, about a row for IN_BUCKET of
    them; the keys aren't kept. ``lookup`` gives each key a number of its own below the number of keys.

    Keys fall into buckets by their hash; a bucket's seed is the first that sends its keys to different places. Seeds are
    tried for all buckets at once, more of them for the few that are left. Without keys there are no rows.
    """
    once = keys.select(F.col(key).alias("__k")).where("__k is not null").distinct()
    n = once.count()
    buckets = max(1, n // IN_BUCKET)
    once = materialize(once.select(F.xxhash64("__k", F.lit(1)).alias("h"), F.pmod(F.xxhash64("__k"), F.lit(buckets)).alias("bucket")), "hashes")
    sizes = once.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("h").alias("d"))
    sizes = sizes.withColumn("size", F.when(F.col("d") < F.col("size"), F.raise_error(F.lit("two keys have one hash"))).otherwise(F.col("size"))).drop("d")
    open_, done, low, tries = materialize(once.join(sizes, "bucket"), "open"), None, 0, 64
    while not open_.isEmpty():
        tried = open_.withColumn("seed", F.explode(F.sequence(F.lit(low), F.lit(low + tries - 1))))
        taken = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _slot("h", "seed", "size")))
        fits = tried.groupBy("bucket", "size", "seed").agg(taken.alias("taken")).where("bit_count(taken) = size")
        found = materialize(fits.groupBy("bucket", "size").agg(F.min("seed").alias("seed")), "seeds")
        done = found if done is None else done.union(found)
        open_ = materialize(open_.join(found, "bucket", "left_anti"), "open")
        low, tries = low + tries, tries * 8
    if done is None:
        return once.sparkSession.createDataFrame([], "bucket bigint, first bigint, size bigint, seed int")
    return running(done.select("bucket", "size", "seed"), keys=[], time="bucket", sums={"__end": "size"}).select("bucket", (F.col("__end") - F.col("size")).alias("first"), "size", "seed")


def lookup(index: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """``asked`` with ``ordinal``, the number of its key in the perfect hash; of keys that weren't in it any number, NULL for NULL."""
    per = index.agg(F.greatest(F.lit(1), F.floor(F.coalesce(F.sum("size"), F.lit(0)) / IN_BUCKET)).cast("bigint").alias("n")).scalar()
    x = asked.withColumn("__h", F.xxhash64(key, F.lit(1))).withColumn("__b", F.pmod(F.xxhash64(key), per))
    met = x.join(index.select(F.col("bucket").alias("__b"), F.col("first").alias("__first"), F.col("size").alias("__size"), F.col("seed").alias("__seed")), "__b", "left")
    return met.select(*asked.columns, F.when(F.col(key).isNotNull(), F.col("__first") + _slot("__h", "__seed", "__size")).alias("ordinal"))


def repeated_keys(entries: DataFrame) -> DataFrame:
    """(``k``, ``n``): keys that occur more than once."""
    return entries.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ordinals(keys: DataFrame) -> DataFrame:
    """(``k``, ``ordinal``): the position of each different key."""
    return global_rank(keys.select("k").where("k is not null").distinct(), order="k", name="ordinal")


def longest_matches(texts: DataFrame, patterns: DataFrame, *, text_id: str, text: str, pattern: str) -> DataFrame:
    """(``text_id``, ``begin``, ``end``, ``pattern``): at each position the longest pattern that begins there, without matches
    that lie inside an earlier one.

    Patterns are cut into blocks of BLOCK_CHARS and each block goes over the texts with one automaton, so time grows with
    the texts and the matches, not with the number of patterns in a block. Texts are read whole. NULL and empty texts and
    patterns match nothing; positions count characters; each text must have an id of its own.
    """
    kind = texts.schema[text_id].dataType.simpleString()
    found = None
    for block in _blocks(r[0] for r in patterns.select(pattern).where(F.length(pattern) > 0).distinct().toLocalIterator()):
        part = _longest_of_block(texts, block, text_id, text, kind)
        found = part if found is None else found.union(part)
    if found is None:
        return texts.sparkSession.createDataFrame([], f"`{text_id}` {kind}, begin int, end int, pattern string")
    return found if found is part else _across_blocks(found, text_id)


def _blocks(words: Iterable[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for w in words:
        if block and size + len(w) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(w)
        size += len(w)
    if block:
        yield block


def _across_blocks(found: DataFrame, text_id: str) -> DataFrame:
    """What is left of the matches of several blocks: those that reach further than every match that begins earlier or there."""
    longest = found.groupBy(text_id, "begin").agg(F.max(F.struct("end", "pattern")).alias("x")).select(text_id, "begin", "x.end", "x.pattern")
    ahead = running(longest.withColumn("__neg", -F.col("end")), keys=[text_id], time="begin", mins={"__reached": "__neg"}, before=True)
    return ahead.where(F.col("__reached").isNull() | (F.col("__neg") < F.col("__reached"))).select(text_id, "begin", "end", "pattern")


def _longest_of_block(texts: DataFrame, words: list[str], text_id: str, text: str, kind: str) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, len(w))
        automaton.make_automaton()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not (t := t.as_py()):
                    continue
                longest: dict[int, int] = {}
                for last, size in automaton.iter(t):
                    longest[last + 1 - size] = max(last + 1, longest.get(last + 1 - size, 0))
                reached = 0
                for begin in sorted(longest):
                    if longest[begin] > reached:
                        reached = longest[begin]
                        for column, x in zip(out, (i, begin, reached, t[begin:reached])):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], [text_id, "begin", "end", "pattern"])

    return texts.select(text_id, text).mapInArrow(find, f"`{text_id}` {kind}, begin int, end int, pattern string")
