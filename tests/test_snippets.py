"""Code snippets hold the whole content of their document."""

from corvid import plans

DATA = "/root/testdata/sf0.001"


def test_content_is_whole(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = plans.queries()["code_snippets"](spark, DATA).collect()
    assert max(len(r.content) for r in got) > 100
    assert all(r.content == texts[r.id] for r in got)
