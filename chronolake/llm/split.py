"""Splitting oversized texts at natural boundaries, by dynamic programming over boundary positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm.tokens import encoder, token_lengths
from chronolake.session import spread

MAX_TOKENS = 4096
OVERLAP = 128
#: What a cut costs: at a paragraph, line, sentence, word, character, inside a character.
PENALTY = np.array([0.0, 1.0, 4.0, 16.0, 64.0, 4096.0])
CUTS = ("paragraph", "line", "sentence", "word", "character", "byte", "end")
BALANCE = 10.0
#: Parts of a step: finer boundaries come in where coarser ones lie further apart than one of the first, one in one of the second.
SPARSE, THIN = 16, 128


def boundary_levels(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """For each byte offset (0 < offset < length) the level of a cut before it: an index of CUTS."""
    b = np.frombuffer(data, np.uint8)
    pad = np.concatenate([np.zeros(4, np.uint8), b])
    at = offsets + 4
    now, p1, p2, p3 = pad[at], pad[at - 1], pad[at - 2], pad[at - 3]
    space = lambda x: (x == 32) | ((x >= 9) & (x <= 13))
    level = np.full(len(offsets), 4, np.int8)
    level[(now & 0xC0) == 0x80] = 5
    level[(space(now) | space(p1)) & (level == 4)] = 3
    stop = ((p1 == 46) | (p1 == 33) | (p1 == 63)) & space(now)
    wide = ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x82)) | ((p3 == 0xEF) & (p2 == 0xBC) & ((p1 == 0x81) | (p1 == 0x9F)))
    level[(stop | wide) & (level < 5)] = 2
    level[p1 == 10] = 1
    level[(p1 == 10) & ((p2 == 10) | ((p2 == 13) & (p3 == 10)))] = 0
    return level


def _cheapest(at: np.ndarray, pen: np.ndarray, n: int, most: int, overlap: int, target: float) -> list[int]:
    """The cheapest ends of pieces among the positions ``at``, the last of which is ``n``; none if no choice keeps the limit."""
    step = most - overlap
    cost, back = np.full(len(at), np.inf), np.full(len(at), -1)
    low = np.searchsorted(at, at - step)
    for i in range(len(at)):
        if at[i] <= most:
            cost[i] = BALANCE * ((at[i] - overlap - target) / step) ** 2
        lo = low[i]
        if lo < i:
            c = cost[lo:i] + BALANCE * ((at[i] - at[lo:i] - target) / step) ** 2
            j = int(c.argmin())
            if c[j] < cost[i]:
                cost[i], back[i] = c[j], lo + j
        cost[i] += pen[i]
    if not np.isfinite(cost[-1]):
        return []
    cuts, i = [], len(at) - 1
    while i >= 0:
        cuts.append(int(at[i]))
        i = int(back[i])
    return cuts[::-1]


def best_cuts(levels: np.ndarray, n: int, most: int, overlap: int) -> list[int]:
    """Ends of the pieces of ``n`` tokens, the last is ``n``. ``levels[i]``: level of a cut before token i (0 < i < n).

    A piece has at most ``most`` tokens, of which all but the first piece's repeat ``overlap``. Minimises the sum of cut
    penalties and of squared differences from equal lengths. Positions are the paragraph and line ends; where two lie
    more than a SPARSEth of a step apart, finer boundaries are added between them, level by level, one in a THINth of a
    step. Around the cuts so found, unless all are line ends, all positions are then tried, until none is better.
    """
    step = most - overlap
    sparse, thin = max(1, step // SPARSE), max(1, step // THIN)
    target = (n - overlap) / max(1, -(-(n - overlap) // step))
    use = levels <= 1
    for level in range(2, 6):
        at = np.concatenate([[0], np.flatnonzero(use), [n]])
        wide = np.flatnonzero(np.diff(at) > sparse)
        if not len(wide):
            break
        for k in wide:
            finer = at[k] + 1 + np.flatnonzero(levels[at[k] + 1 : at[k + 1]] <= level)
            use[finer[np.r_[True, finer[1:] // thin != finer[:-1] // thin]] if len(finer) else finer] = True
    cuts: list[int] = []
    while True:
        at = np.concatenate([np.flatnonzero(use), [n]])
        at = at[at > overlap]
        found = _cheapest(at, np.concatenate([PENALTY[levels[at[:-1]]], [0.0]]), n, most, overlap, target)
        if found == cuts or not found or thin == 1 or (levels[found[:-1]] <= 1).all():
            return found  # next to a line end no finer cut is worth its penalty
        cuts = found
        for c in cuts[:-1]:
            use[max(1, c - thin) : c + thin + 1] = True


def split_text(text: str, path: str, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple]:
    """Pieces of a text with more than ``most`` tokens: (first token, end token, first character, first new character,
    end character, name of the cut at its end). Nothing for other texts. If a piece, encoded alone, has more than ``most``
    tokens, the text is cut again with a limit that much smaller; if no limit is small enough, that is an error."""
    e = encoder(path)
    tokens = e.encode_ordinary(text)
    n = len(tokens)
    if n <= most:
        return []
    data = text.encode()
    offsets = np.concatenate([[0], np.cumsum(token_lengths(path)[np.array(tokens)])])
    levels = np.full(n, 5, np.int8)
    levels[1:] = boundary_levels(data, offsets[1:-1])
    early = np.maximum(np.arange(n) - overlap, 0)  # a piece begins there; it must not begin inside a character
    levels[(levels < 5) & (early > 0) & (levels[early] == 5)] = 5
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    limit = most
    while True:
        pieces, begin = [], 0
        cuts = best_cuts(levels, n, limit, overlap)
        if not cuts:
            break
        for end in cuts:
            first = max(0, begin - overlap)
            cut = CUTS[int(levels[end])] if end < n else CUTS[-1]
            pieces.append((first, end, int(chars[offsets[first]]), int(chars[offsets[begin]]), int(chars[offsets[end]]), cut))
            begin = end
        over = max(len(e.encode_ordinary(text[p[2] : p[4]])) for p in pieces) - most
        if over <= 0:
            return pieces
        limit -= over
        if limit <= overlap + 1:
            break
    raise ValueError(f"the text can't be cut into pieces of at most {most} tokens with an overlap of {overlap}")


def split_oversized(
    documents: DataFrame, *, path: str, doc_id: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, with_text: bool = True
) -> DataFrame:
    """(``doc_id``, ``piece_no``, ``n_pieces``, ``tok_start``, ``tok_end``, ``char_start``, ``char_new``, ``char_end``,
    ``cut``, ``piece``): the pieces of texts with more than ``max_tokens`` tokens of the tokenizer in the file ``path``.

    Each piece has at most ``max_tokens`` tokens and, but for the first, starts with the last ``overlap`` tokens of the
    piece before. Texts from ``char_new`` to ``char_end`` put together give the document back. A text has no more tokens
    than bytes, so shorter ones are passed over without being encoded. ``piece`` is NULL unless ``with_text``.

    Other texts, empty and NULL ones, have no rows. Repeated documents come out as often as they come in.
    """
    if not 0 <= overlap < max_tokens // 2:
        raise ValueError("the overlap must be less than half of max_tokens")
    long = spread(documents.where(F.octet_length(text) > max_tokens).select(doc_id, text))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                pieces = split_text(t, path, max_tokens, overlap)
                for k, p in enumerate(pieces):
                    for column, x in zip(out, (d, k, len(pieces), *p, t[p[2] : p[4]] if with_text else None)):
                        column.append(x)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    names = [doc_id, "piece_no", "n_pieces", "tok_start", "tok_end", "char_start", "char_new", "char_end", "cut", "piece"]
    kind = documents.schema[doc_id].dataType.simpleString()
    return long.mapInArrow(cut, f"`{doc_id}` {kind}, piece_no int, n_pieces int, tok_start bigint, tok_end bigint, char_start bigint, char_new bigint, char_end bigint, cut string, piece string")
