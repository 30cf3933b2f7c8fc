"""Functions that must agree with Python to the last bit, as Arrow-batched pandas UDFs."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts, the correct answer first (the measure isn't symmetric)."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def py_round(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounds the exact binary value, halves to even."""
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")


def edits(a: Sequence, b: Sequence) -> int:
    """Edit distance of two texts, or lists of words. What they begin and end with alike costs nothing; if the rest of one
    is the rest of the other with something left out, the difference of their lengths is the distance, in linear time.
    Else a column of the table at a time: bit i of `up` and `down` says whether the entry at i is one more or one less
    than the entry above it, so a column costs a few operations on long integers."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    first, last, n = 0, 0, len(b)
    while first < n and a[first] == b[first]:
        first += 1
    while last < n - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : n - last]
    rest = iter(a)
    if all(c in rest for c in b):
        return len(a) - len(b)
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, len(a) - 1
    up, down, last = full, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right = down | (full & ~(diagonal | up))
        left = diagonal & up
        last += (right >> top & 1) - (left >> top & 1)
        right, left = right << 1 | 1, left << 1
        up = (left | ~(diagonal | right)) & full
        down = right & diagonal & full
    return last


@F.pandas_udf(LongType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distances of long texts; null where either is null."""
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def word_edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distances of long texts in words; null where either is null."""
    return pd.Series([None if x is None or y is None else edits(x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype="Int64")
