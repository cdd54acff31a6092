"""Text similarity: the Indel ratio (100 * 2 * LCS / sum of lengths) as an Arrow UDF; Spark has no built-in for it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def indel(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    # longest common subsequence with one bit for each character of a
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & at.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    lcs = len(a) - row.bit_count()
    return 200.0 * lcs / (len(a) + len(b))


def _ratio(a: Column, b: Column) -> Column:
    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else indel(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(batch, "double")(a, b)


def ratio(a: Column, b: Column) -> Column:
    """0 to 100; null if either is null."""
    return _ratio(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """ratio() of both texts' words in sorted order."""
    words = lambda c: F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")), " ")
    return _ratio(words(a), words(b))
