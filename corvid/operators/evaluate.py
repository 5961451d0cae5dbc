"""Scores of answers and their aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C


def precision_over_ranks(rows: DataFrame, by: str, relevant: str, rank: str) -> DataFrame:
    """The mean of precision at each rank of the group; 0 without relevant rows."""
    frame = Window.partitionBy(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = rows.withColumn("_p", F.sum(F.col(relevant).cast("int")).over(frame) / F.row_number().over(Window.partitionBy(by).orderBy(rank)))
    return at.groupBy(by).agg(F.avg("_p").alias("context_precision"))


def supported_share(pairs: DataFrame, by: str | list[str], statement: str, similarity: str, threshold: float = C.SUPPORT_THRESHOLD) -> DataFrame:
    """Faithfulness: the share of a group's statements whose best similarity exceeds the threshold."""
    by = [by] if isinstance(by, str) else by
    per = pairs.groupBy(*by, statement).agg(F.max(similarity).alias("_s"))
    return per.groupBy(*by).agg(F.avg(F.when(F.col("_s") > threshold, 1.0).otherwise(0.0)).alias("faithfulness"))


def overall(*metrics: str) -> Column:
    """The mean of the metrics that are not null."""
    values = F.filter(F.array(*[F.col(m) for m in metrics]), lambda x: x.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def summarized(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, population deviation, median and 95th percentile (interpolated)."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95")
    )


def compared(rows: DataFrame, dataset: str, metric: str, value: str, low_is_best: tuple[str, ...] = ("latency",)) -> DataFrame:
    """Each metric's mean by dataset, with the best dataset of each metric."""
    means = rows.groupBy(dataset, metric).agg(F.avg(value).alias("mean"))
    rank = F.when(F.col(metric).isin(*low_is_best), -F.round("mean", 6)).otherwise(F.round("mean", 6))
    first = F.row_number().over(Window.partitionBy(metric).orderBy(F.desc(rank), F.asc(dataset)))
    return means.withColumn("is_best", first == 1)


def distribution(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Minimum, quartiles and maximum."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    out = rows.groupBy(*by).agg(q.alias("_q"))
    return out.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])
