"""Queries on exports, result folders, prompts for code, times and JSON."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.vector import dense_score
from ..operators import rewrite, search
from ..operators.quantiles import quantiles
from ..sources import exports
from .common import query, table
from .retrieval import _ranked, _vectors
from .tables import _place


@query("SELECT event_id, user_id::VARCHAR AS evaluator_id, round(value, 4)::DOUBLE AS overall, strftime(ts, '%Y%m%d_%H%M%S') AS taken, 'human_eval_results_20240102_030405.json' AS file, (SELECT count(*) FROM events)::BIGINT AS exported FROM events")
def human_eval_export(spark, sf_dir):
    """Evaluations exported under a name with a time, and read again."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("evaluator_id"), F.round("value", 4).alias("overall"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("taken"))
    done = exports.human_evaluations(rows, _place(spark), at=datetime(2024, 1, 2, 3, 4, 5))
    name = done["filename"].rpartition("/")[2]
    return spark.read.schema(rows.schema).json(done["filename"]).withColumns({"file": F.lit(name), "exported": F.lit(done["count"]).cast("long")})


@query("SELECT event_type AS dataset, count(*)::BIGINT AS n, round(avg(value), 4)::DOUBLE AS faithfulness FROM events GROUP BY event_type")
def benchmark_results(spark, sf_dir):
    """One JSON file for each type of event, found in a folder and read."""
    folder = _place(spark)
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dataset")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("faithfulness"))
    rows.repartition("dataset").write.option("maxRecordsPerFile", 1).json(folder)
    return exports.benchmark_results(spark, folder, rows.schema).select("dataset", "n", "faithfulness")


@query("""SELECT item_id, 'Please explain this code:' || chr(10) || chr(10) || text AS explain,
CASE WHEN item_id % 2 = 0 THEN 'I''m getting this error in my code:' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Error: E' || item_id || chr(10) || chr(10) || 'How can I fix this?'
ELSE 'Can you help me debug this code?' || chr(10) || chr(10) || text END AS debug FROM benchmark""")
def code_prompts(spark, sf_dir):
    error = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("E"), F.col("item_id").cast("string"))).when(F.col("item_id") % 4 == 1, F.lit(""))
    return table(spark, sf_dir, "benchmark").select("item_id", rewrite.explain_prompt(F.col("text")).alias("explain"), rewrite.debug_prompt(F.col("text"), error).alias("debug"))


@query(_ranked("CASE WHEN rank = 5 THEN 0.0 ELSE round(1 - l2, 6) END::DOUBLE", "l2"))
def dense_from_distance(spark, sf_dir):
    """Distances as scores; the fifth hit is taken to have none."""
    hits = search.top_k(*_vectors(spark, sf_dir))
    return hits.select("query_id", "id", F.round(dense_score(F.when(F.col("rank") < 5, F.col("score"))), 6).alias("score"), "rank")


_SHARES = {"low": 0.0, "q1": 0.25, "p50": 0.5, "p95": 0.95, "p99": 0.99, "high": 1.0}


@query("SELECT event_type AS metric, count(*)::BIGINT AS n, " + ", ".join(f"round(quantile_cont(value, {q}), 4)::DOUBLE AS {name}" for name, q in _SHARES.items()) + " FROM events WHERE value IS NOT NULL GROUP BY event_type")
def bounded_percentiles(spark, sf_dir):
    """Percentiles without holding a group's values in a task."""
    rows = quantiles(table(spark, sf_dir, "events").withColumnRenamed("event_type", "metric"), "value", ["metric"], _SHARES)
    return rows.select("metric", "n", *[F.round(name, 4).alias(name) for name in _SHARES])
