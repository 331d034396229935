"""Token counts: the estimate in the JVM, or exact ones of a public vocabulary in Arrow batches."""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.functions.text import token_estimate


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(col: Column | str, vocabulary: str | None = None, pattern: str | None = None) -> Column:
    """Tokens of a text: exact for the vocabulary of ranks at a path, else a quarter of its characters; null is null."""
    if vocabulary is None:
        return token_estimate(col)

    def count(texts):
        own = _encoding(vocabulary, pattern)
        return texts.map(lambda t: None if t is None else len(own.encode_ordinary(t))).astype("Int32")

    import pandas as pd

    count.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(count, T.IntegerType())(col)
