"""Vectors kept between jobs."""

from pyspark.sql import functions as F

from corvid.operators.embedcache import EmbeddingCache
from corvid.operators.hooks import hashed_embedding


def test_only_misses_are_embedded(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 5}", "x") for i in range(12)] + [(90, None, "x"), (91, "", "x")], "id long, text string, digest string")
    cache = EmbeddingCache(spark, str(tmp_path / "c"), "m")
    got, made = cache.embed(rows, hashed_embedding)
    want = {r.id: r.v for r in rows.select("id", hashed_embedding(F.col("text")).alias("v")).collect()}
    assert made == 6 and {r.id: r.vector for r in got.collect()} == want and got.columns == ["id", "text", "digest", "vector"]
    never = lambda x: F.raise_error(F.lit("embedded again")).cast("array<double>")
    again, made = EmbeddingCache(spark, str(tmp_path / "c"), "m").embed(rows, never)
    assert made == 0 and {r.id: r.vector for r in again.collect()} == want
    _, made = cache.embed(spark.createDataFrame([(1, "text 1"), (2, "new")], "id long, text string"), hashed_embedding)
    assert made == 1
    _, made = EmbeddingCache(spark, str(tmp_path / "c"), "other").embed(rows, hashed_embedding)
    assert made == 6  # another model's vectors are its own
    _, made = cache.embed(rows.limit(0), never)
    assert made == 0
    # two writers at once: the same text twice, read once
    cache.store.add(cache.store.read(where={"model": "m"}))
    twice, made = cache.embed(rows, never)
    assert made == 0 and twice.count() == rows.count() and {r.id: r.vector for r in twice.collect()} == want
    assert len(cache.store.files({"model": "m", "digest": {"$in": ["0"]}})) == 0
