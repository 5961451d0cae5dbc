"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_corvid").rstrip("/")


@contextlib.contextmanager
def _releasing(spark: SparkSession):
    """Spark removes a query's shuffle files when the query ends, by its own setting."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage with files that outlive any executor, so the shuffle
    files behind the written table can go as soon as it stands.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvid-{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    with _releasing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._corvid_path = path  # for release()
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._corvid_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
