"""Values that can be checked by hand, and independent versions of what SQL can't express."""

import pytest
from pyspark.sql import functions as F

from corvid.functions import text as X
from corvid.functions import vector as V
from corvid.operators import chunk, compress, evaluate, hooks, memory, quantize, rewrite, search
from corvid.sources import files, store
from corvid.streaming import memory as streams


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_fixed_chunks(spark):
    rows = chunk.fixed(spark.createDataFrame([("abcdefghij",)], ["text"]), size=4, overlap=1).orderBy("chunk_ord")
    assert [(r.content, r.start_index, r.end_index) for r in rows.collect()] == [("abcd", 0, 4), ("defg", 3, 7), ("ghij", 6, 10), ("j", 9, 13)]
    assert chunk.fixed(spark.createDataFrame([("",)], ["text"])).count() == 0
    for bad in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            chunk.fixed(spark.createDataFrame([("a",)], ["text"]), size=bad[0], overlap=bad[1])


def test_sentences(spark):
    rows = chunk.sentences(spark.createDataFrame([("Paris is the capital. The tower opened in 1889! Is it tall? Yes",)], ["text"])).collect()
    assert len(rows) == 4 and rows[-1].content == "Yes"


def test_code_windows():
    assert chunk.code_windows("x" * 2500, 1000, 100) == [(0, 1000), (900, 1900), (1800, 2800), (2700, 3700)][:3]
    assert chunk.code_windows("x" * 950, 1000, 100) == [(0, 1000), (900, 1900)]
    ends = chunk.code_windows("a\n" + "b" * 2000, 1000, 100)
    assert all(b > a for a, b in ends) and ends[-1][1] >= 2002  # it ends


def test_code_lines():
    lines = ["x" * 400] * 4
    assert chunk.code_lines(lines, 1000, 100) == [(0, 3), (3, 4)]
    lines = ["x" * 400, "y" * 350, "async def f():", "  pass"]
    assert chunk.code_lines(lines, 1000, 100) == [(0, 2), (0, 4)]
    assert chunk.code_lines(["def f():"], 1000, 100) == [(0, 1)]


def test_code_dispatch(spark):
    rows = chunk.code(spark.createDataFrame([(1, "def f():\n    return 1"), (2, "some prose, (not code"), (3, None), (4, "")], ["id", "text"])).collect()
    assert {r.id: r.type for r in rows} == {1: "python_code", 2: "code"}


def test_rewriting(spark):
    assert one(spark, rewrite.expansions(F.col("q")), q="What is the capital of France?") == ["What is the capital of France?", "what is the city of france?", "what is the center of france?"]
    assert one(spark, rewrite.expansions(F.col("q")), q="Explain it") == ["Explain it", "explartificial intelligencen it", "explmachine learningn it"]
    assert one(spark, rewrite.parts(F.col("q")), q="What is AI and how does it work?") == ["What is AI and how does it work?", "What is AI", "how does it work?"]
    assert one(spark, rewrite.parts(F.col("q")), q="A AND b") == ["A AND b", "A AND b"][:2]
    assert one(spark, rewrite.accepted(F.col("q"), F.lit(" short ")), q="original") == "original"


def test_text_scalars(spark):
    assert one(spark, X.keywords(F.col("q")), q="What is the capital of France?") == ["capital", "france"]
    q = "What is the capital of France?"
    assert round(one(spark, X.overlap_score(F.col("q"), F.col("t")), q=q, t="Paris is the capital city of France."), 6) == 0.666667
    assert round(one(spark, X.overlap_score(F.col("q"), F.col("t")), q=q, t="France is in Europe."), 6) == 0.166667
    assert one(spark, X.is_greeting(F.col("q")), q="what is this") is True
    assert one(spark, X.is_greeting(F.col("q")), q="hello there my friend") is False
    assert one(spark, X.parse_score(F.col("q")), q="1.2.3") == 0.5
    assert one(spark, X.parse_score(F.col("q")), q="0.75") == 0.75
    assert one(spark, X.loader_of(X.extension(F.col("q"))), q="/a/b.DOCX") == "docx"
    assert one(spark, X.repeats_itself(F.col("q")), q="ab" * 100) is True


def test_scaling(spark):
    rows = spark.createDataFrame([(1, 0.2), (1, 0.5), (1, 0.8), (2, 0.3), (2, 0.3)], ["query_id", "s"])
    got = sorted((r.query_id, round(r.x, 6)) for r in search.min_max(rows, "s", "x").collect())
    assert got == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 1.0), (2, 1.0)]


def test_zero_vectors(spark):
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0
    q = spark.createDataFrame([(1, [1.0, 0.0])], ["query_id", "vector"])
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, None)], "id long, vector array<double>")
    assert [(r.id, r.score) for r in search.top_k(q, c, 5, "cosine").orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]
    with pytest.raises(ValueError):
        search.top_k(q, c, 5, "other")


def test_lsh_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = rows.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    c = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    want = {(r.query_id, r.id) for r in search.top_k(q, c).collect()}
    got = {(r.query_id, r.id) for r in search.approximate(q, c).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_quantising(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (2, [0.4, 0.5, 0.6]), (3, [0.7, 0.8, 0.9])], ["vec_id", "embedding"])
    got = quantize.quantize(rows).withColumn("back", quantize.restored(F.col("codes"), F.col("bounds"))).orderBy("vec_id").collect()
    assert [r.codes for r in got] == [[0, 0, 0], [127, 127, 127], [255, 255, 255]]
    assert all(abs(a - b) <= 0.6 / 255 + 1e-9 for r in got for a, b in zip(r.back, r.embedding, strict=True))
    assert one(spark, quantize.from_binary(quantize.binary(F.col("v"))), v=[-1, 0, 2]) == [-1, -1, 1]
    with pytest.raises(ValueError):
        quantize.quantize(rows, "other")


def test_budget(spark):
    rows = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((400, 400, 4000, 4))], ["conv_id", "turn", "text"])
    got = compress.prefix(rows, "conv_id", [F.asc("turn")]).collect()
    assert [r.turn for r in got] == [0, 1] and got[-1].used_tokens == 200


def test_statistics(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 10)], ["k", "v"])
    r = evaluate.summarized(rows, "v", ["k"]).first()
    assert round(r.p95, 6) == 8.95 and round(r.std, 6) == 3.535534


def test_precision_over_ranks(spark):
    for bits, want in (([1, 0, 1], 0.722222), ([0, 1], 0.25), ([0, 0], 0.0)):
        rows = spark.createDataFrame([(1, b, i) for i, b in enumerate(bits, 1)], ["q", "rel", "rank"])
        assert round(evaluate.precision_over_ranks(rows, "q", "rel", "rank").first().context_precision, 6) == want


def test_store(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "store"))
    held.add(spark.createDataFrame([(1, "a"), (2, "b")], ["id", "text"]))
    held.add(spark.createDataFrame([(3, "c")], ["id", "text"]))
    held.update(spark.createDataFrame([(2, "B"), (9, "z")], ["id", "text"]))
    held.delete(spark.createDataFrame([(1,)], ["id"]))
    assert sorted(map(tuple, held.read().collect())) == [(2, "B"), (3, "c")]
    assert held.peek(1)[0] == 2
    with pytest.raises(ValueError):
        store.appended(str(tmp_path / "t"), spark.createDataFrame([(1,)], ["id"]), spark.createDataFrame([(2, [0.0])], ["id", "v"]))


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo\nworld")
    (tmp_path / "b.md").write_text("# head")
    (tmp_path / "c.exe").write_text("no")
    (tmp_path / "d.pdf").write_bytes(b"no pdf")
    got = {r.path.rpartition("/")[2]: (r.file_type, r.text, r.error is None) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("text", "héllo\nworld", True) and got["b.md"][1] == "# head" and "c.exe" not in got
    assert got["d.pdf"][1] is None and not got["d.pdf"][2]
    assert files.config(str(tmp_path / "none.yaml"))["retrieval"]["k"] == 5


def test_hooks(spark):
    with pytest.raises(ValueError):
        hooks.component("embedder", "none")
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], ["id", "text"])
    upper = hooks.generate_udf(lambda: lambda texts: [t.upper() for t in texts])
    assert {r.x for r in rows.where("text is not null").select(upper("text").alias("x")).collect()} == {"A B"}
    got = {r.id: r.vector for r in hooks.embed_distinct(rows, "text", hooks.hashed_embedding).collect()}
    assert got[1] == got[2] and sum(got[1]) == 2 and got[3] is None


def test_memory(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", "x" * 120) for i in range(5)], ["conv_id", "turn", "role", "text"])
    lines = memory.summary(turns).first().summary.split("\n")
    assert len(lines) == 3 and lines[0].startswith("A: ") and lines[0].endswith("...") and len(lines[0]) == 106


def test_streamed_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, frame in (("tumbling", streams.windows(stream)), ("sliding", streams.windows(stream, "1 day", "12 hours")), ("sessions", streams.sessions(stream))):
        frame.writeStream.outputMode("complete" if name != "sessions" else "append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select sum(n) from tumbling").first()[0] == events.count()
    assert spark.sql("select sum(n) from sliding").first()[0] == 2 * events.count()


def test_label_means_cover_all_rows(spark):
    questions = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    rows = [(i, [1.0, 0.0], 0) for i in range(30)] + [(40, [-1.0, 0.0], 7), (41, [0.0, 1.0], 8), (42, [1.0, 1.0], 8), (43, None, 9)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>, label long")
    got = {(r.query_id, r.label): round(r.similarity, 4) for r in search.label_means(questions, corpus).collect()}
    assert got == {(1, 0): 1.0, (1, 7): 0.0, (1, 8): 0.3536}


def test_fused_questions_that_repeat(spark):
    import numpy as np

    from corvid.operators import tfidf

    docs = [(i, f"w{i} w{i % 3} red fox", [float(i % 4), 1.0]) for i in range(12)]
    corpus = spark.createDataFrame(docs, "id long, text string, vector array<double>")
    idf = tfidf.vocabulary(tfidf.term_stats(corpus))
    corpus = tfidf.weighed(corpus, idf)
    dense = lambda rows: search.dense_scores(np.array(rows["vector"].tolist(), float), 2)
    sparse = lambda rows: tfidf.sparse_scores(tfidf.Scorer(idf, rows["text"].tolist()), 3, 4)
    schema = "query_id long, text string, vector array<double>"
    run = lambda rows: search.fused(spark.createDataFrame(rows, schema), corpus, dense, sparse, lambda a, b: a / 2 + b / 2, ("d", "s", "f"), 3)
    once = sorted(map(tuple, run([(1, "w1 fox", [1.0, 0.0]), (2, "w2", [0.0, 1.0])]).collect()))
    many = sorted(map(tuple, run([(2, "w2", [0.0, 1.0]), (1, "w1 fox", [1.0, 0.0]), (1, "w1 fox", [1.0, 0.0]), (None, "w3", [1.0, 1.0]), (1, "zz", [9.0, 9.0])]).collect()))
    assert once == many and len(once) == 6
    assert run([]).count() == 0


@pytest.mark.parametrize("limit", [3, 40, 100_000])
def test_term_stats(spark, limit):
    import math
    import random
    from collections import Counter

    from corvid.operators import tfidf

    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["the", "fox", "Red", "dög", "x", "w1", "w2", "w3"] + [f"v{i}" for i in range(30)]) for _ in range(rnd.randint(0, 40))) for _ in range(80)] + [None, ""]
    counts = [Counter(tfidf.grams(t)) for t in texts]
    total, df = Counter(), Counter()
    for c in counts:
        total.update(c)
        df.update(c.keys())
    want = sorted(total, key=lambda t: (-total[t], t))[:limit]
    got = tfidf.term_stats(spark.createDataFrame([(t, "x") for t in texts], "text string, term string").repartition(3), limit).collect()
    assert sorted((r.term, r.total, r.df, round(r.idf, 9)) for r in got) == sorted((t, total[t], df[t], round(math.log((len(texts) + 1) / (df[t] + 1)) + 1, 9)) for t in want)


def test_systems(spark):
    from corvid.operators import system

    docs = spark.createDataFrame([(1, "Paris is the capital of France. " * 3), (2, "Rome is in Italy. It is old."), (3, None), (4, ""), (None, "Paris")], "id long, text string")
    q = spark.createDataFrame([(1, "What is the capital of France and how old is Rome?"), (1, "What is the capital of France and how old is Rome?"), (2, None), (None, "Rome")], "query_id long, text string")
    base = {"text_splitter": {"type": "sentence"}, "retrieval": {"k": 2}}
    run = lambda **more: system.compiled(base | more).retrieve(q, docs).orderBy("rank").collect()
    plain = run()
    assert {r.query_id for r in plain} == {1} and len({r.content for r in plain}) == len(plain) <= 2
    assert run(strategy="no such strategy") == plain == run(strategy="none")
    parts = run(strategy="decomposition")
    assert {r.content for r in plain} < {r.content for r in parts} and [r.rank for r in parts] == list(range(1, len(parts) + 1))
    scores = [r.score for r in run(reranker={"type": "simple"})]
    assert scores == sorted(scores, reverse=True)
    assert len(run(context_compression={"type": "prefix", "max_tokens": 8})) == 1
    said = spark.createDataFrame([(1, 0, "user", "Tell me about Italy.")], "query_id long, turn long, role string, text string")
    assert system.compiled(base).asked(q, said).first().text.startswith("Previous conversation:\nQ: Tell me about Italy.")
    for part in ("text_splitter", "embedder", "vector_store", "generator", "reranker", "context_compression"):
        with pytest.raises(ValueError, match="no such"):
            system.compiled({part: {"type": "no such"}})
    for bad in ({"retrieval": {"k": 0}}, {"text_splitter": {"chunk_size": 10, "chunk_overlap": 10}}):
        with pytest.raises(ValueError):
            system.compiled(bad)


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("retrieval:\n  k: 7\nstrategy: hyde\n")
    assert files.config(str(path))["retrieval"]["k"] == 7 and files.config(str(path))["text_splitter"]["chunk_size"] == 500
    assert files.config(str(tmp_path / "none"))["retrieval"]["k"] == 5
    with pytest.raises(FileNotFoundError):
        files.config(str(tmp_path / "none"), needed=True)
