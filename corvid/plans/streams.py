"""Queries on streams with state, restarted from their checkpoint on the way."""

from __future__ import annotations

import contextlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.store import Store
from ..streaming import dialogue, evalqueue
from .common import query, table
from .tables import _place


@contextlib.contextmanager
def _rocks(spark):
    before = spark.conf.get(dialogue.PROVIDER[0])
    spark.conf.set(*dialogue.PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(dialogue.PROVIDER[0], before)


def _fed(spark, parts, frame):
    """Run a stream over one part after the other, each run starting from the last one's checkpoint; what its sink holds."""
    path, held = _place(spark), Store(spark, f"{_place(spark)}/out")
    with _rocks(spark):
        for rows in parts:
            rows.write.mode("append").parquet(f"{path}/in")
            stream = frame(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
            sink = evalqueue.written(held, "stream")
            stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return held.read()


@query("""WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE conv_id % 3 <> 0 OR turn > 2)
SELECT c.conv_id, count(t.conv_id)::BIGINT AS n_turns, coalesce(sum(length(t.text)), 0)::BIGINT AS n_chars
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id = c.conv_id AND back <= 3 GROUP BY c.conv_id""")
def stream_dialogue(spark, sf_dir):
    """Turns and clears in any order, then, after a restart, what is remembered of each conversation."""
    turns = table(spark, sf_dir, "conversations")
    at = F.to_timestamp(F.lit("2024-01-01"))
    said = turns.select("conv_id", (F.col("turn") * 10).alias("seq"), at.alias("ts"), F.lit("turn").alias("kind"), "role", "text")
    each = lambda rows, seq, kind: rows.select("conv_id").distinct().select("conv_id", F.lit(seq).cast("long").alias("seq"), at.alias("ts"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    events = said.union(each(turns.where("conv_id % 3 = 0"), 25, "clear"))
    part = lambda k: events.where(F.pmod(F.xxhash64("conv_id", "seq"), F.lit(2)) == k)
    rows = _fed(spark, [part(0), part(1), each(turns, 1000, "info")], lambda stream: dialogue.dialogues(stream, n=3))
    return rows.where("kind = 'info'").select("conv_id", "n_turns", "n_chars")


@query("""WITH i AS (SELECT item_id, item_id % 4 AS q, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) AS place FROM benchmark)
SELECT 'assigned' AS kind, q::VARCHAR AS queue, item_id, 'e' || ((place - 1) % 3) AS evaluator, NULL::DOUBLE AS score FROM i WHERE place <= 6
UNION ALL SELECT 'done', q::VARCHAR, item_id, 'e' || (place - 1), place / 8 FROM i WHERE place <= 3""")
def stream_queue(spark, sf_dir):
    """Items in four queues; three evaluators of each take one, end it, and after a restart take the next."""
    items = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 4).cast("string").alias("queue"))
    first = items.withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy("item_id"))).where("place <= 3")
    at = F.to_timestamp(F.lit("2024-01-01"))
    event = lambda rows, seq, kind, item, who, score: rows.select("queue", seq.cast("long").alias("seq"), at.alias("ts"), F.lit(kind).alias("kind"), item.cast("long").alias("item_id"), who.cast("string").alias("evaluator"), score.cast("double").alias("score"))
    none, place, who = F.lit(None), F.col("place"), F.concat(F.lit("e"), (F.col("place") - 1).cast("string"))
    come = event(items, F.col("item_id"), "item", F.col("item_id"), none, none).union(event(first, place + 10**12, "ready", none, who, none))
    go = event(first, place * 2 + 2 * 10**12, "done", F.col("item_id"), who, place / 8).union(event(first, place * 2 + 1 + 2 * 10**12, "ready", none, who, none))
    rows = _fed(spark, [come, go], evalqueue.decisions)
    return rows.select("kind", "queue", "item_id", "evaluator", "score")
