"""Texts stay where they are: what evaluation and retrieval move between tasks."""

from pyspark.sql import functions as F

from corvid.operators import system
from corvid.plans import evaluation


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contexts_move_once(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Words of {c} here. Words of {c} here. More {t}!") for c in range(6) for t in range(4)] + [(9, 0, "user", None), (9, 1, "assistant", "An answer.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = evaluation.faithfulness(spark, str(tmp_path))
        # all is moved by conversation, nothing to its text
        keys = [x.split("#")[0] for x in _plan(out).split("Exchange hashpartitioning(")[1:]]
        assert keys and set(keys) == {"conv_id"}
        assert {r.conv_id for r in out.collect()} == {0, 1, 2, 3, 4, 5, 9}
        got = {(r.conv_id, r.turn): r.answer_relevancy for r in evaluation.answer_relevancy(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got[9, 1] == 0.0 and got[0, 1] > 0.5  # nothing is like a question without text


def test_chunks_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"red fox {i} runs. Blue sea {i % 3}.") for i in range(40)], "id long, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "blue sea")], "query_id long, text string")
    own = system.compiled({"text_splitter": {"type": "sentence"}, "retrieval": {"k": 3}})
    assert "Exchange" not in _plan(own.chunks(docs))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = own.retrieve(asked, docs)
        assert "BroadcastHashJoin" in _plan(out) and "SortMergeJoin" not in _plan(out)
        found = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    vectors = own.chunks(docs).select("chunk_id", "vector")
    assert found == sorted(map(tuple, own.retrieve(asked, docs, vectors=vectors).collect())) and len(found) > 3
    assert out.where(F.col("content").isNull()).count() == 0
