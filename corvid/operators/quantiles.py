"""Exact percentiles of groups of any size, in bounded memory.

A percentile lies between two order statistics, whose ranks are known once a group is
counted. Each is sought in an interval of values, at first from the least to the
greatest. A pass counts the values of each interval in ``BUCKETS`` equal parts, with the least
and greatest value of each part; the part that holds the rank is the next interval. The
ends of an interval have parts of their own, so every pass leaves less, also where
values are far apart or infinite. When an interval's ends are equal its rank is found.

A pass reads the values once, sums them in each task, and shuffles at most
``BUCKETS`` rows for each interval and task, so a group may hold any share of all rows: no task
holds its values. Smoothly spread values need two to four passes. What is held between
passes, a row for each group and rank, is written.

Nulls and NaN are left out, and so are groups of nothing else; a null group is a
group. Ties and repeated rows count as often as they come. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def _written(df: DataFrame) -> DataFrame:
    """A small table in the folder that driver and executors share, so that passes don't pile up."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path, schema = f"{base.rstrip('/')}/corvid-quantiles-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _part(value: Column, low: Column, high: Column) -> Column:
    """The part of an interval that a value falls into; both ends have their own."""
    share = (value - low) / (high - low)
    inner = F.when(share.isNotNull() & ~F.isnan(share), F.floor(share * (BUCKETS - 2))).otherwise(F.lit(0)).cast("int")
    return F.when(value == low, F.lit(0)).when(value == high, F.lit(BUCKETS - 1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(BUCKETS - 2), inner + 1)))


def quantiles(rows: DataFrame, value: str, by: list[str], at: dict[str, float]) -> DataFrame:
    """``by``, n and, for each name of ``at``, the group's interpolated percentile of that share."""
    if not at or any(not 0 <= q <= 1 for q in at.values()):
        raise ValueError("shares must be from 0 to 1")
    base = rows.select(F.struct(*by).alias("key"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    counts = _written(base.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    place = {name: F.lit(q) * (F.col("n") - 1) for name, q in at.items()}
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]))
    targets = _written(counts.select("key", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before")))
    done = [targets.where("low = high")]
    while not (left := targets.where("low < high")).isEmpty():
        # the intervals of a group are apart or the same, so a value is in one at most
        spans = left.select("key", "low", "high", "before").distinct()
        inside = base.join(spans, "key").where("v >= low and v <= high")
        parts = inside.groupBy("key", "low", "high", "before", _part(F.col("v"), F.col("low"), F.col("high")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        along = Window.partitionBy("key", "low").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("start", F.col("before") + F.sum("n").over(along) - F.col("n")).drop("before", "high")
        hit = left.select("key", "rank", "low").join(parts, ["key", "low"]).where("rank >= start and rank < start + n")
        targets = _written(hit.select("key", "rank", F.col("least").alias("low"), F.col("most").alias("high"), F.col("start").alias("before")))
        done.append(targets.where("low = high"))
    found = functools.reduce(DataFrame.union, done).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("found"))
    both = counts.select("key", "n").join(found, "key")

    def between(p: Column) -> Column:
        low, high = (F.col("found")[f(p).cast("long")] for f in (F.floor, F.ceil))
        share = p - F.floor(p)
        return F.when(low == high, low).otherwise(low * (1 - share) + high * share)

    return both.select(*[F.col("key")[c].alias(c) for c in by], "n", *[between(p).alias(name) for name, p in place.items()])
