"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary is read from; never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sizes(documents: DataFrame, path: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens and the columns in keep, of every document with a text (an empty text has 0 tokens)."""
    base = documents.where(F.col("text").isNotNull()).select("doc_id", *keep, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for b in batches:
            yield b.drop(columns="text").assign(n_tokens=[len(enc.encode_ordinary(t)) for t in b["text"]])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name != "text")
    return base.mapInPandas(run, f"{schema}, n_tokens bigint")
