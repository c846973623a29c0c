"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The vocabulary used if no path is given; the installed package of public tokenizers knows where it lies.
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoder(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Number of tokens of the whole text; null for null.  Special strings in a text are ordinary text.

    ``vocabulary`` is a path every executor can read.
    """

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoder(vocabulary)
        return pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count(text)


def sized(docs: DataFrame, key: str, text: str, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """(key, *keep, tokens): rows with a text, with its size.  Only the columns named are read."""
    return docs.where(F.col(text).isNotNull()).select(key, *keep, token_count(F.col(text), vocabulary).alias("tokens"))
