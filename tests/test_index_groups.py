"""A text index scores groups of documents in memory: no pairs are joined, and only versions that are read have tables."""

from pyspark.sql import functions as F

from corvid.operators import tfidf
from corvid.operators.text_index import TextIndex

DATA = "/root/testdata/sf0.01"


def rows(df):
    return sorted((r.query_id, r.id, r.score, r.rank) for r in df.collect())


def test_groups(spark, tmp_path):
    q = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    d = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    index = TextIndex(spark, str(tmp_path / "i"), limit=3000)
    index.add(d.where("id % 3 > 0").repartition(9))
    index.add(d.where("id % 3 = 0").repartition(5))
    assert not (tmp_path / "i" / "sums").exists()
    hits, left, blocks = index._hits(q, 5, 6, 2)
    assert left.count() < blocks.count()
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert rows(index.search(q)) == rows(tfidf.search(q, d, limit=3000))
    assert len(list((tmp_path / "i" / "sums").iterdir())) == 1


def test_parsed_texts_have_the_same_terms(spark):
    texts = ["The red fox, the red dog", None, "", "a of", "Straße İstanbul x y2 fox red fox red"] * 3
    docs = spark.createDataFrame([(i, x, " ".join(tfidf.grams(x, False)) or None) for i, x in enumerate(texts)], "id long, text string, words string")
    for limit in (4, 1000):  # pairs by number, and as they are
        assert tfidf.term_stats(docs, limit).orderBy("term").collect() == tfidf.term_stats(docs, limit, text="words", parsed=True).orderBy("term").collect()
