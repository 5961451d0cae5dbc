"""Models as plug-ins, with deterministic stand-ins for use without any model.

A hook is a callable on a list of texts (or pairs); it runs inside an iterator
pandas UDF, so what ``make`` returns is loaded once for each Python worker. The
stand-ins are no models and are never presented as such.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap_score
from ..functions.vector import hashed


def embed_udf(make: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """A pandas UDF text -> array<double> from a factory of embedders."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(model(batch.tolist()))

    return run


def score_udf(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    """A pandas UDF (question, text) -> double from a factory of pair scorers."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in batches:
            yield pd.Series(model(list(zip(q, t, strict=True))))

    return run


def generate_udf(make: Callable[[], Callable[[list[str]], list[str]]]):
    """A pandas UDF prompt -> text from a factory of generators."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(model(batch.tolist()))

    return run


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Stand-in embedder: token counts by hash."""
    return hashed(dim)(text)


def overlap_scorer(question: Column, text: Column) -> Column:
    """Stand-in reranker."""
    return overlap_score(question, text)


def constant_scorer(question: Column, text: Column) -> Column:
    """What a reranker gives when its model is missing: one score, so the order stays."""
    return F.lit(0.5)


def first_sentence(text: Column) -> Column:
    """Stand-in summariser and generator."""
    return F.element_at(F.split(text, r"(?U)(?<=[.!?])\s+"), 1)


def embed_distinct(rows: DataFrame, text: str, embed: Callable[[Column], Column], name: str = "vector") -> DataFrame:
    """Embed each distinct text once and join the vectors back, so that none is mixed up or computed twice."""
    vectors = rows.where(F.col(text).isNotNull()).select(text).distinct().withColumn(name, embed(F.col(text)))
    return rows.join(vectors, text, "left")


EMBEDDERS: dict[str, Callable] = {"hashed": hashed_embedding}
RERANKERS: dict[str, Callable] = {"simple": overlap_scorer, "constant": constant_scorer}
GENERATORS: dict[str, Callable] = {"extractive": first_sentence}


def component(kind: str, name: str) -> Callable:
    """A registered component; unknown names raise ``ValueError``."""
    registry = {"embedder": EMBEDDERS, "reranker": RERANKERS, "generator": GENERATORS}
    try:
        return registry[kind][name]
    except KeyError:
        raise ValueError(f"unknown {kind} {name}") from None
