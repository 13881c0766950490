"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every machine; a parameter of all that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind split text before merging.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_loaded: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file of ranks; read once in each process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """The number of tokens of the whole text; 0 for null and ''. Strings of special tokens are ordinary text."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(path)
        for b in batches:
            yield pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in b], dtype="int64")

    return F.pandas_udf(count, "bigint")(text)


def sized(documents: DataFrame, *keep: str, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, *keep, n_tokens) of the texts with a token at least."""
    return documents.filter("text is not null and text <> ''").select("doc_id", *keep, token_count(F.col("text"), path).alias("n_tokens")).filter("n_tokens > 0")
