"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies by default, as the driver sees it; it is sent to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this public vocabulary splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str, split: str):
    """The tokenizer of a rank file; read once per process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=split, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, split: str = SPLIT) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of the whole text; 0 for an empty one, null for null."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(SparkFiles.get(name), split).encode_ordinary
        for batch in batches:
            sizes = [None if t is None else len(encode(t)) for t in batch["__text"]]
            yield batch.drop(columns="__text").assign(n_tokens=pd.Series(sizes, dtype="Int64", index=batch.index))

    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInPandas(run, f"{ddl}, n_tokens long")
