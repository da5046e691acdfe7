"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie on every worker.
TOKENIZER_DIR = os.environ.get("FRAMELODE_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that cuts text into pieces for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The encoder of a rank file, loaded once per worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_tokens(df: DataFrame, text: str, name: str = "tokens", *, directory: str = TOKENIZER_DIR, ranks: str = RANKS) -> DataFrame:
    """Add ``name``: the tokens of the whole ``text``, 0 for null and empty ones."""
    path = f"{directory}/{ranks}"

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        e = encoder(path)
        return texts.map(lambda t: len(e.encode_ordinary(t)) if t else 0)

    return df.withColumn(name, count.asNondeterministic()(F.col(text)))
