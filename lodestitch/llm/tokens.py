"""Token counts with a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Place of the byte-level BPE vocabulary; pass another path to use another vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file."""
    with open(path, "rb") as f:
        return _encoder(f.read())


@lru_cache(maxsize=4)
def _encoder(data: bytes):
    """The tokenizer of a vocabulary, made once per Python worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_count(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row; a null text has no tokens. The vocabulary file is read here and sent to the
    executors, which need no copy of it."""
    key_type = df.schema[key].dataType.simpleString()
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(shared.value)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "n_tokens": n})

    return df.select(key, text).mapInPandas(count, f"{key} {key_type}, n_tokens long")


def as_long(c: str) -> Column:
    return F.col(c).cast("long")
