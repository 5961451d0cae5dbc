"""Quantising tables of vectors ``(vec_id, embedding)``.

Ranges are taken over the whole table: one partial aggregation of all
dimensions, whose result (two numbers a dimension) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranges(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(dim, mn, mx) of each dimension."""
    return vectors.select(F.posexplode(column).alias("dim", "x")).groupBy("dim").agg(F.min(F.col("x").cast("double")).alias("mn"), F.max(F.col("x").cast("double")).alias("mx"))


def _bounds(vectors: DataFrame, column: str) -> DataFrame:
    rows = ranges(vectors, column).agg(F.sort_array(F.collect_list(F.struct("dim", "mn", "mx"))).alias("bounds"))
    return F.broadcast(rows)  # one row, as long as a vector


def scalar(vectors: DataFrame, bits: int = 8, column: str = "embedding") -> DataFrame:
    """Adds ``codes``: each value's place in its dimension's range as an integer of ``bits`` bits, cut towards zero."""
    top = float((1 << bits) - 1)
    code = F.zip_with(column, "bounds", lambda x, b: ((x.cast("double") - b["mn"]) / F.when(b["mx"] == b["mn"], F.lit(1.0)).otherwise(b["mx"] - b["mn"]) * top).cast("int"))
    return vectors.join(_bounds(vectors, column), how="cross").withColumn("codes", code)


def restored(codes: Column, bounds: Column, bits: int = 8) -> Column:
    top = float((1 << bits) - 1)
    return F.zip_with(codes, bounds, lambda q, b: q / top * F.when(b["mx"] == b["mn"], F.lit(1.0)).otherwise(b["mx"] - b["mn"]) + b["mn"])


def product(vectors: DataFrame, parts: int = 4, bits: int = 8, column: str = "embedding") -> DataFrame:
    """Adds ``parts``: the codes cut into contiguous sub-vectors, the last taking the rest."""
    n = F.size("codes")
    step = F.greatest(F.floor(n / parts).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("codes", p * step + 1, F.when(p == parts - 1, F.greatest(n - p * step, F.lit(0))).otherwise(step)))
    return scalar(vectors, bits, column).withColumn("parts", cut)


def binary(column: Column) -> Column:
    return F.transform(column, lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)))


def from_binary(column: Column) -> Column:
    return F.transform(column, lambda b: b * 2 - 1)


def quantize(vectors: DataFrame, kind: str = "scalar", bits: int = 8, column: str = "embedding") -> DataFrame:
    """Dispatch by kind: scalar, product or binary."""
    if kind == "scalar":
        return scalar(vectors, bits, column)
    if kind == "product":
        return product(vectors, bits=bits, column=column)
    if kind == "binary":
        return vectors.withColumn("codes", binary(F.col(column)))
    raise ValueError(f"unknown kind {kind}")
