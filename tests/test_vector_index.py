"""The inverted file of vectors against exact search."""

import numpy as np
from pyspark.sql import functions as F

from corvid.operators import search
from corvid.operators.vector_index import VectorIndex


def vectors(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    corpus = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), corpus


def test_recall_and_reading(spark, tmp_path):
    """These vectors have no clusters to speak of: many cells' codes are read, and few vectors."""
    q, c = vectors(spark, "sf0.1")
    found = VectorIndex(spark, str(tmp_path / "i")).build(c).measured(q, c)
    assert found["recall"] >= 0.9 and found["vectors"] < 0.05


def test_clusters_are_told_apart(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((40, 16)) * 10
    rows = [(i, (middles[i % 40] + rng.standard_normal(16)).tolist()) for i in range(4000)]
    c = spark.createDataFrame(rows, "id long, vector array<double>")
    q = c.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = VectorIndex(spark, str(tmp_path / "i")).build(c)
    found = index.measured(q, c)
    assert found["recall"] >= 0.9 and found["vectors"] < 0.05 and found["codes"] < 0.1
    one = index.shortlisted(q.limit(1))
    plan = one._jdf.queryExecution().toString()
    assert "cell" in plan[plan.rindex("PartitionFilters") :][:80]  # other cells are not read


def test_all_cells_and_rows_are_exact(spark, tmp_path):
    q, c = vectors(spark, "sf0.001")
    index = VectorIndex(spark, str(tmp_path / "i")).build(c)
    n = c.count()
    got = index.search(q, 5, probes=10_000, short=n)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.top_k(q, c, 5).select("query_id", "id", "score", "rank").collect()))
    assert index.rows().count() == n


def test_appending_and_odd_rows(spark, tmp_path):
    q, c = vectors(spark, "sf0.001")
    index = VectorIndex(spark, str(tmp_path / "i")).build(c)
    far = [9.0] * 64
    index.append(spark.createDataFrame([(900_001, far), (900_001, far), (None, far), (900_002, None)], "id long, vector array<double>"))
    hits = index.search(spark.createDataFrame([(7, far), (7, far), (None, far), (8, None)], "query_id long, vector array<double>"), 2).collect()
    assert [(r.query_id, r.id, r.score) for r in hits] == [(7, 900_001, 0.0)] * 2
    none = VectorIndex(spark, str(tmp_path / "none")).build(c.limit(0))
    assert none.search(q).count() == 0 and none.rows().count() == 0
    none.append(c)
    assert none.rows().count() == c.count() and none.search(q, 1).where("query_id = id").count() == q.count()
