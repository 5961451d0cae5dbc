"""Fitting ranked contexts into a budget of tokens (a token is four characters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate


def prefix(rows: DataFrame, by: str, order: list[Column], text: str = "text", budget: int = 1000) -> DataFrame:
    """Rows in order while their tokens fit; the first that does not fit ends the list."""
    frame = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used_tokens", F.sum(token_estimate(F.col(text))).over(frame).cast("long")).where(F.col("used_tokens") <= budget)


def extractive(rows: DataFrame, by: str, score: str, tie: str, text: str = "text", budget: int = 1000, least: int = 10) -> DataFrame:
    """Rows of at least ``least`` characters by score, then ``prefix``."""
    return prefix(rows.where(F.length(F.trim(F.col(text))) >= least), by, [F.desc(score), F.asc(tie)], text, budget)


def abstractive(rows: DataFrame, by: str, order: list[Column], summary: Column, budget: int = 1000, least: int = 50, text: str = "text") -> DataFrame:
    """Summaries of rows of at least ``least`` characters, then ``prefix``."""
    return prefix(rows.where(F.length(F.trim(F.col(text))) >= least).withColumn("summary", summary), by, order, "summary", budget)


def sliding(rows: DataFrame, by: str, order: str, text: str = "text", window: int = 5, budget: int = 1000) -> DataFrame:
    """The last ``window`` rows, oldest first, then ``prefix``."""
    last = rows.withColumn("_back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_back") <= window).drop("_back")
    return prefix(last, by, [F.asc(order)], text, budget)


def hybrid(rows: DataFrame, by: str, score: str, tie: str, text: str = "text", budget: int = 1000) -> DataFrame:
    """Extractive compression; its result always fits, so that nothing is left to summarise."""
    return extractive(rows, by, score, tie, text, budget)
