"""Streams with state: control events, restarts, leases, and results written once."""

import pytest
from pyspark.sql import functions as F

from corvid.sources.store import Store
from corvid.streaming import dialogue, evalqueue

EVENT = "conv_id long, seq long, ts timestamp, kind string, role string, text string"
ITEM = "queue string, seq long, ts timestamp, kind string, item_id long, evaluator string, score double"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(dialogue.PROVIDER[0])
    spark.conf.set(*dialogue.PROVIDER)
    yield spark
    spark.conf.set(dialogue.PROVIDER[0], before)


def put(spark, path, schema, rows, at="2024-01-01 00:00:00"):
    """One more file of a stream; rows are given without their time, or with it as text."""
    place = schema.split(", ").index("ts timestamp")
    rows = [(*r[:place], at, *r[place:]) if len(r) < len(schema.split(", ")) else r for r in rows]
    spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)


def run(spark, frame, tmp_path, sink):
    query = frame(spark.readStream.option("maxFilesPerTrigger", 1)).writeStream.option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
    query.foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


def test_dialogues_over_a_restart(rocks, tmp_path):
    spark, path = rocks, str(tmp_path / "in")
    held = Store(spark, str(tmp_path / "out"))
    frame = lambda reader: dialogue.dialogues(reader.schema(EVENT).parquet(path), n=3)

    def go():
        run(spark, frame, tmp_path, evalqueue.written(held, "dialogue"))

    put(spark, path, EVENT, [(1, s, "turn", "user", f"t{s}") for s in range(5)] + [(2, 0, "turn", "user", "x"), (None, 1, "turn", "user", "no one"), (1, None, "turn", "user", "lost")])
    put(spark, path, EVENT, [(1, 5, "history", None, None), (2, 1, "info", None, None), (3, 9, "info", None, None)])
    go()
    # the stream is started anew from its checkpoint
    put(spark, path, EVENT, [(1, 6, "clear", None, None), (1, 7, "turn", "assistant", "t7"), (1, 4, "turn", "user", "late"), (1, 7, "turn", "assistant", "t7")])
    put(spark, path, EVENT, [(1, 9, "history", None, None), (1, 8, "turn", "user", "t8"), (2, 5, "clear", None, None), (2, 6, "info", None, None), (None, 2, "info", None, None)])
    go()
    got = {(r.conv_id, r.seq): (r.kind, r.n_turns, r.n_chars, [t.text for t in r.turns] if r.turns is not None else None) for r in held.read().collect()}
    assert got == {
        (1, 5): ("history", 3, 6, ["t2", "t3", "t4"]),
        (2, 1): ("info", 1, 1, None),
        (3, 9): ("info", 0, 0, None),
        (1, 6): ("cleared", 3, 8, None),  # turn 4 came once more, with another text
        (1, 9): ("history", 2, 4, ["t7", "t8"]),
        (2, 5): ("cleared", 1, 1, None),
        (2, 6): ("info", 0, 0, None),
        (None, 2): ("info", 1, 6, None),
    }


def test_idle_dialogues_expire(rocks, tmp_path):
    spark, path = rocks, str(tmp_path / "in")
    held = Store(spark, str(tmp_path / "out"))
    frame = lambda reader: dialogue.dialogues(reader.schema(EVENT).parquet(path), n=3, idle_seconds=60, late="1 second")
    for minute, conv in ((0, 1), (5, 2), (10, 2)):
        put(spark, path, EVENT, [(conv, minute, "turn", "user", "hello")], f"2024-01-01 00:{minute:02d}:00")
        run(spark, frame, tmp_path, evalqueue.written(held, "dialogue"))
    put(spark, path, EVENT, [(1, 13, "info", None, None)], "2024-01-01 00:13:00")
    run(spark, frame, tmp_path, evalqueue.written(held, "dialogue"))
    rows = [(r.conv_id, r.kind, r.n_turns) for r in held.read().collect()]
    assert (1, "expired", 1) in rows and (2, "expired", 2) in rows and (1, "info", 0) in rows


def test_evaluation_queue(rocks, tmp_path):
    spark, path = rocks, str(tmp_path / "in")
    held = Store(spark, str(tmp_path / "out"))
    frame = lambda reader: evalqueue.decisions(reader.schema(ITEM).parquet(path), lease_seconds=60, late="1 second")
    ran = []

    def sink(batch, number):
        batch = batch.persist()
        for _ in range(2):  # as if each batch were run again after its result was written
            evalqueue.written(held, "queue")(batch, number)
        ran.append(number)
        batch.unpersist()

    def step(minute, rows):
        put(spark, path, ITEM, [("q", s, kind, item, who, score) for s, kind, item, who, score in rows], f"2024-01-01 00:{minute:02d}:00")
        run(spark, frame, tmp_path, sink)

    step(0, [(i, "item", i, None, None) for i in range(5)] + [(10, "ready", None, "ann", None), (11, "ready", None, "bob", None), (12, "ready", None, "ann", None)])
    step(0, [(20, "done", 0, "ann", 0.5), (21, "ready", None, "ann", None), (22, "left", None, "bob", None), (23, "done", 0, "bob", 0.9), (24, "item", 3, None, None)])
    step(5, [(30, "ready", None, "cyd", None)])  # ann's lease of item 2 runs out behind the watermark
    step(6, [(40, "done", 2, "ann", 0.7), (41, "ready", None, "dan", None)])  # late, but the first
    step(7, [(50, "done", 3, "cyd", 0.1), (51, "ready", None, "cyd", None), (52, "ready", None, "eve", None), (53, "done", 2, "eve", 0.2)])
    rows = held.read().collect()
    assert len(ran) == len(set(ran))
    assigned = [(r.item_id, r.evaluator) for r in rows if r.kind == "assigned"]
    done = {r.item_id: (r.evaluator, r.score) for r in rows if r.kind == "done"}
    assert {(0, "ann"), (1, "bob"), (2, "ann")} <= set(assigned)
    assert (1, "bob") in [(r.item_id, r.evaluator) for r in rows if r.kind == "requeued"] and (2, "ann") in [(r.item_id, r.evaluator) for r in rows if r.kind == "requeued"]
    assert done == {0: ("ann", 0.5), 2: ("ann", 0.7), 3: ("cyd", 0.1)} and sum(r.kind == "done" for r in rows) == 3
    # nobody holds two items, no item is held twice: each assignment after the first follows a requeue
    for item in range(5):
        n = sum(i == item for i, _ in assigned)
        assert 1 <= n <= 1 + sum(r.kind == "requeued" and r.item_id == item for r in rows)


def test_dealing_to_queues(spark):
    rows = [(None, i, None, "item", i, None, None) for i in range(100)] + [(None, 200 + i, None, "ready", None, f"p{i % 10}", None) for i in range(30)]
    got = evalqueue.sharded(spark.createDataFrame(rows, ITEM), 4).collect()
    assert {r.queue for r in got} == {"0", "1", "2", "3"}
    assert all(len({r.queue for r in got if r.evaluator == f"p{i}"}) == 1 for i in range(10))
