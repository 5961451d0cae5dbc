"""Column functions on vectors (arrays of numbers), in double precision."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def dense_score(distance: Column) -> Column:
    """A distance as a score, 1 - distance; 0 without one."""
    return F.coalesce(1 - distance, F.lit(0.0))


def clamped_cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))


@functools.lru_cache(1 << 15)
def _place(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16)


def hashed(dim: int = 64):
    """A pandas UDF text -> array<double>: counts of word tokens by MD5, a deterministic stand-in for an embedding."""

    def one(text: str) -> np.ndarray:
        counts = Counter(_WORD.findall(text.lower()))
        return np.bincount([_place(t) % dim for t in counts], list(counts.values()), dim) if counts else np.zeros(dim)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(x) if x is not None else None for x in texts], dtype=object)

    return run
