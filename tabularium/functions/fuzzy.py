"""Similarity and accent folding, which no built-in expresses: Arrow-batched."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, 0 to 1; null if either side is null."""
    seen: dict[tuple[str, str], float] = {}

    def one(x, y):
        if x is None or y is None:
            return None
        if (x, y) not in seen:
            seen[x, y] = SequenceMatcher(None, x, y).ratio()
        return seen[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Lower case without accents: compatibility decomposition, ASCII only."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x.lower().strip()).encode("ascii", "ignore").decode())
