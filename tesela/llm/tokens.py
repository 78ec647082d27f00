"""Sizes of texts in tokens of a public tokenizer; its file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; another place may be named in the environment or as an argument.
TOKENIZER = os.path.join(os.environ.get("TESELA_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: The public splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def count(s: pd.Series) -> pd.Series:
        e = encoding(path)
        return s.map(lambda t: len(e.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)
