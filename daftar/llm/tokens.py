"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("DAFTAR_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a file of ranks; each worker reads the file once."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def measured(df: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """``df`` with ``n_tokens`` in the place of ``text``; a null text has none and leaves, an empty one has 0."""
    rest = [c for c in df.columns if c != text and c != "n_tokens"]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), "n_tokens int"])

    # The file goes with the job, so executors need no copy of their own.
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(SparkFiles.get(name))
        for b in batches:
            texts = b.pop("__text")
            b["n_tokens"] = pd.Series([len(enc.encode_ordinary(t)) for t in texts], index=b.index, dtype="int32")
            yield b

    return df.where(F.col(text).isNotNull()).select(*rest, F.col(text).alias("__text")).mapInPandas(run, schema)
