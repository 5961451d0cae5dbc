"""Results written out and read again."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _fs


def human_evaluations(results: DataFrame, folder: str, kind: str = "json", at: datetime | None = None) -> dict:
    """Export human evaluations to ``folder/human_eval_results_<time>.json``; any other ``kind`` raises ``ValueError``.

    The file is a folder of lines, one part for each task; ``at`` is now, in UTC, unless
    given. Gives status, format, filename and count.
    """
    if kind != "json":
        raise ValueError(f"Unsupported format: {kind}")
    name = f"{folder.rstrip('/')}/human_eval_results_{at or datetime.now(UTC):%Y%m%d_%H%M%S}.json"
    results.write.json(name)
    count = results.sparkSession.read.schema(results.schema).json(name).count()
    return {"status": "exported", "format": kind, "filename": name, "count": count}


def benchmark_results(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """path and the fields of each ``*.json`` of a folder, each file one object; no rows if there is no folder or no such file.

    A file that is no object of the schema has nulls.
    """
    found = [n for n in _fs.names(spark, folder) if n.endswith(".json")]
    if not found:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType()), *schema.fields]))
    rows = spark.read.text(f"{folder.rstrip('/')}/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("r"))
    return rows.select("path", "r.*")
