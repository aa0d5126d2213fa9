"""Token ids of a public byte-level vocabulary; any other function from text to a list takes its place."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import PurePath

import pandas as pd
from pyspark import SparkContext, SparkFiles
from pyspark.sql import Column
from pyspark.sql import functions as F

#: One base64 token and its rank a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary splits text before merging bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Ids of the whole text, null for null. The file is read on the driver's machine and sent to the workers."""
    SparkContext.getOrCreate().addFile(vocabulary)
    name = PurePath(vocabulary).name

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            yield pd.Series([None if x is None else encode(x) for x in batch], dtype=object)

    ids.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(ids, "array<int>")(text)
