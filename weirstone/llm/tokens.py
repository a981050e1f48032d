"""Token counts by a public tokenizer whose vocabulary lies outside the repository."""

from __future__ import annotations

import base64
import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tiktoken ranks file, and the pattern that cuts texts before merging (a fixed value).
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(4)
def encoder(vocabulary):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_column(vocabulary: str = VOCABULARY):
    """A pandas UDF text -> number of tokens; null texts have none."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(vocabulary)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return count


def sized(documents: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, *keep, n_tokens) of the documents with an id and at least one token."""
    some = documents.select("doc_id", *keep, "text").where("doc_id is not null and text is not null and text <> ''")
    return some.select("doc_id", *keep, count_column(vocabulary)("text").alias("n_tokens")).where("n_tokens > 0")
