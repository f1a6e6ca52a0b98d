"""Tokens of a public tokenizer, by its file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE vocabularies of this family cut a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoder(path: str):
    """The tokenizer of a file of base64 tokens and ranks; loaded once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def token_lengths(path: str) -> np.ndarray:
    """Bytes of each token id."""
    e = encoder(path)
    out = np.zeros(max(e._mergeable_ranks.values()) + 1, np.int64)
    for token, rank in e._mergeable_ranks.items():
        out[rank] = len(token)
    return out


def count_tokens(text: Column, path: str) -> Column:
    """Tokens of each text; 0 for NULL and empty."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    return count(text)
