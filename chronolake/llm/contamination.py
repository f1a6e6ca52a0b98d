"""Evaluation texts leaking into training text: a prefix-filtered join of word shingles."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm.mime import text_parts, words
from chronolake.plans.skew import plan_bytes
from chronolake.session import materialize, spread

SHINGLE = 5
WINDOW = 13
#: Bytes of item windows up to which they are broadcast; the size is known, as they are written before.
MAX_BROADCAST = 64 << 20
#: Bits of the mask of shingles that items have: about BITS_EACH a shingle, at most 2**MAX_BITS.
BITS_EACH, MIN_BITS, MAX_BITS = 32, 16, 30
REMEMBERED = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit numbers of words, the same in every process; those met last are remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit number for each run of ``size`` numbers of words."""
    n = max(0, len(ids) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size if n else 0):
        h = (h ^ ids[j : j + n]) * _BASE
        h ^= h >> np.uint64(29)
    return h


def _numbers(w: list[str], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))


def item_windows(items: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """(``item``, ``at``, ``win``, ``sh``): every window of every item, where it begins, its words and its shingles. Items with
    fewer words have none."""
    kind = items.schema[item_id].dataType.simpleString()
    per = window - SHINGLE + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words(text.as_py() or "")
                h = shingle_hashes(_numbers(w, memo)).view(np.int64)
                n = len(w) - window + 1
                for start in range(0, n, 4096):
                    at = range(start, min(n, start + 4096))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(at), batch.schema.field(0).type), pa.array(at, pa.int32()), pa.array([w[k : k + window] for k in at], pa.list_(pa.string())), pa.array([h[k : k + per] for k in at], pa.list_(pa.int64()))],
                        ["item", "at", "win", "sh"],
                    )

    return items.select(item_id, item_text).mapInArrow(cut, f"item {kind}, at int, win array<string>, sh array<bigint>")


def shingle_mask(windows: DataFrame) -> np.ndarray:
    """A mask of the low bits of all shingles of the windows: at most 128 MB, whatever the items. Pieces of it come to the
    driver compressed, one after another."""
    n = windows.count()
    bits = int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(max(1, n) * BITS_EACH)))))
    low = np.uint64((1 << bits) - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, some = np.zeros((1 << bits) // 8, np.uint8), False
        for batch in batches:
            slot = np.unique(batch.column(0).flatten().to_numpy().view(np.uint64) & low).astype(np.int64)
            if len(slot):
                byte, some = slot >> 3, True
                first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
                mask[byte[first]] |= np.bitwise_or.reduceat((128 >> (slot & 7)).astype(np.uint8), first)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(mask.tobytes(), 1)], pa.binary())], ["mask"])

    whole = np.zeros((1 << bits) // 8, np.uint8)
    for row in windows.select("sh").coalesce(8).mapInArrow(mark, "mask binary").toLocalIterator():
        whole |= np.frombuffer(zlib.decompress(row[0]), np.uint8)
    return whole


def _scanner(mask: np.ndarray, window: int, read: Callable, doc_id: str):
    """Batches of documents to batches of their parts that hold shingles of the items."""
    per = window - SHINGLE + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bits, low = WordHashes(), mask.value, np.uint64(len(mask.value) * 8 - 1)
        for batch in batches:
            ids, parts, positions, tokens, texts = [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part, body in enumerate(read(text.as_py())):
                    w = words(body)
                    if len(w) < window:
                        continue
                    h = shingle_hashes(_numbers(w, memo))
                    slot = h & low
                    at = np.flatnonzero((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1)
                    if not len(at):
                        continue
                    # a window needs that many shingles in a row
                    edges = np.flatnonzero(np.diff(at) != 1)
                    longest = np.diff(np.r_[-1, edges, len(at) - 1]).max()
                    ids.append(d)
                    parts.append(part)
                    positions.append(at.astype(np.int32))
                    tokens.append(h[at].view(np.int64))
                    texts.append(w if longest >= per else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(parts, pa.int32()), pa.array(positions, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.string()))],
                [doc_id, "part", "pos", "sh", "words"],
            )

    return scan


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    read: Callable[[str | None], list[str]] = text_parts,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """(``doc_id``, ``item_id``): documents of which a part holds ``window`` or more consecutive words of an item.

    Sets are the five-word shingles of an item's windows. One pass over the corpus, whatever the number of items, decodes
    each document (``read``) and keeps the positions of shingles that items may have, by a mask of bounded size. Shingles
    are ordered by the number of parts they occur in. A window must be held whole, so its prefix is one shingle: the rarest
    in the corpus. Parts are joined with windows by that token; a candidate must fit between the part's ends (length and
    position) and have exactly the window's words.

    Windows are broadcast if they take less than ``max_broadcast`` bytes, otherwise joined by a shuffle. Items shorter than
    ``window`` can't leak. NULL or empty texts have no words. Repeated documents come out once per id and item. No documents
    or items give an empty result.
    """
    spark = documents.sparkSession
    kind = documents.schema[doc_id].dataType.simpleString()
    windows = materialize(item_windows(items, item_id, item_text, window), "windows")
    mask = spark.sparkContext.broadcast(shingle_mask(windows))
    scan = _scanner(mask, window, read, doc_id)
    parts = spread(documents.select(doc_id, text)).mapInArrow(scan, f"`{doc_id}` {kind}, part int, pos array<int>, sh array<bigint>, words array<string>")
    parts = materialize(parts, "shingles")
    frequency = parts.select(F.explode(F.array_distinct("sh")).alias("sh")).groupBy("sh").agg(F.count(F.lit(1)).alias("df"))
    per = window - SHINGLE + 1
    ranked = windows.select("item", "at", F.posexplode("sh").alias("off", "sh")).join(frequency, "sh")
    prefix = ranked.groupBy("item", "at").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("df", "sh", "off")).alias("p"))
    prefix = windows.select("item", "at", "win").join(prefix.where(F.col("n") == per), ["item", "at"]).select("item", "win", F.col("p.sh").alias("sh"), F.col("p.off").alias("off")).dropDuplicates(["item", "win"])
    if plan_bytes(windows) <= max_broadcast:
        prefix = F.broadcast(prefix)
    hits = parts.where("words is not null").select(doc_id, "words", F.explode(F.arrays_zip("pos", "sh")).alias("x"))
    hits = hits.select(doc_id, "words", F.col("x.pos").alias("pos"), F.col("x.sh").alias("sh")).join(prefix, "sh")
    begin = F.col("pos") - F.col("off")
    fits = (begin >= 0) & (begin + window <= F.size("words"))
    exact = hits.where(fits).where(F.slice("words", begin + 1, window) == F.col("win"))
    return exact.select(doc_id, F.col("item").alias(item_id)).distinct()
