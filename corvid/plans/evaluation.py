"""Queries on metrics, aggregation, quantising and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vector import clamped_cosine
from ..operators import chunk, evaluate, quantize, search
from ..operators.hooks import hashed_embedding
from ..streaming import memory as streams
from .common import TOKEN, query, table
from .retrieval import _VECTORS, _vectors
from .tables import _place


@query(f"""WITH {_VECTORS}, r AS (SELECT s.query_id, s.id, (s.label = o.label)::INT AS rel, row_number() OVER (PARTITION BY s.query_id ORDER BY l2, s.id) AS rank FROM s JOIN embeddings o ON o.vec_id = s.query_id),
"at" AS (SELECT query_id, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) / rank AS prec FROM r WHERE rank <= 10)
SELECT query_id, round(avg(prec), 6)::DOUBLE AS context_precision FROM "at" GROUP BY query_id""")
def context_precision(spark, sf_dir):
    """Equal labels are relevant; mean precision over the ranks of the first ten."""
    q, c = _vectors(spark, sf_dir)
    labels = c.select("id", "label")
    hits = search.top_k(q, c, 10, "l2").join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    rows = evaluate.precision_over_ranks(hits.withColumn("rel", F.col("label") == F.col("own")), "query_id", "rel", "rank")
    return rows.select("query_id", F.round("context_precision", 6).alias("context_precision"))


# --- metrics of conversations: an assistant turn is the answer, user turns are the contexts and the last of them the question ---

_SENT = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def _cos(left: str, right: str, keys: str) -> str:
    """Clamped cosine of the stand-in embeddings of the texts of pairs ``p (key.., a, b)``."""
    return f"""
ta AS (SELECT DISTINCT a AS t FROM p UNION SELECT DISTINCT b FROM p),
tb AS (SELECT t, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS place, count(*) AS c FROM (SELECT t, unnest(regexp_extract_all(lower(t), '{TOKEN}+')) AS tok FROM ta) GROUP BY ALL),
tl AS (SELECT t, sqrt(sum(c * c)) AS l FROM tb GROUP BY t),
dots AS (SELECT x.t AS a, y.t AS b, sum(x.c * y.c) AS d FROM (SELECT DISTINCT a, b FROM p) o JOIN tb x ON x.t = o.a JOIN tb y ON y.t = o.b AND y.place = x.place GROUP BY ALL),
cs AS (SELECT {keys}, p.a, p.b, greatest(0, least(1, coalesce(round(d / (la.l * lb.l), 6), 0)))::DOUBLE AS similarity
  FROM p LEFT JOIN dots USING (a, b) LEFT JOIN tl la ON la.t = p.a LEFT JOIN tl lb ON lb.t = p.b)"""


_CTX = "SELECT conv_id, array_to_string(list(text ORDER BY turn), ' ') AS context, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id"


def _contexts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return turns.groupBy("conv_id").agg(F.array_join(texts, " ").alias("context"), F.max_by("text", "turn").alias("question"))


def _embedded(rows, text, name, *keys):
    """Some columns and the vector of a text, which is made where the text is: neither moves."""
    return rows.select(*keys, hashed_embedding(F.col(text)).alias(name))


def _similar(rows):
    """Adds similarity of the vectors ``_va`` and ``_vb``; 0 where one is null."""
    both = F.col("_va").isNotNull() & F.col("_vb").isNotNull()
    return rows.withColumn("similarity", F.when(both, F.round(clamped_cosine(F.col("_va"), F.col("_vb")), 6)).otherwise(F.lit(0.0))).drop("_va", "_vb")


_STATEMENTS = f"SELECT conv_id, turn, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS a, context AS b FROM (SELECT conv_id, turn, unnest({_SENT}) AS raw FROM conversations WHERE role = 'assistant') JOIN c USING (conv_id) WHERE regexp_replace(raw, '^\\s+|\\s+$', '', 'g') <> ''"
_FAITH = f"WITH c AS ({_CTX}), p AS ({_STATEMENTS}), {_cos('a', 'b', 'conv_id, turn')}, per AS (SELECT conv_id, turn, a, max(similarity) AS s FROM cs GROUP BY ALL)"


def _faithfulness(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    # a context's vector goes to its statements, its text does not
    rows = chunk.sentences(turns.join(_embedded(_contexts(spark, sf_dir), "context", "_vb", "conv_id"), "conv_id"))
    rows = _similar(rows.withColumn("_va", hashed_embedding(F.col("content"))))
    out = evaluate.supported_share(rows, ["conv_id", "turn"], "content", "similarity", 0.4)
    return out.select("conv_id", "turn", F.round("faithfulness", 6).alias("faithfulness"))


@query(f"{_FAITH} SELECT conv_id, turn, round(avg(CASE WHEN s > 0.4 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS faithfulness FROM per GROUP BY ALL")
def faithfulness(spark, sf_dir):
    """The stand-in embedding needs a lower threshold than a model's."""
    return _faithfulness(spark, sf_dir)


_RELEVANCY = f"WITH c AS ({_CTX}), p AS (SELECT conv_id, turn, text AS a, question AS b FROM conversations JOIN c USING (conv_id) WHERE role = 'assistant'), {_cos('a', 'b', 'conv_id, turn')}"


def _answer_relevancy(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    rows = _embedded(turns, "text", "_va", "conv_id", "turn").join(_embedded(_contexts(spark, sf_dir), "question", "_vb", "conv_id"), "conv_id")
    return _similar(rows).select("conv_id", "turn", F.col("similarity").alias("answer_relevancy"))


@query(f"{_RELEVANCY} SELECT conv_id, turn, similarity AS answer_relevancy FROM cs")
def answer_relevancy(spark, sf_dir):
    return _answer_relevancy(spark, sf_dir)


@query(f"""WITH c AS ({_CTX}), p AS (SELECT conv_id, i, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS a, question AS b FROM (
  SELECT conv_id, question, unnest({_SENT.replace('text', 'context')}) AS raw, generate_subscripts({_SENT.replace('text', 'context')}, 1) AS i FROM c) WHERE regexp_replace(raw, '^\\s+|\\s+$', '', 'g') <> ''), {_cos('a', 'b', 'conv_id, i')}
SELECT conv_id, round(avg(similarity), 5)::DOUBLE AS context_relevancy FROM cs GROUP BY conv_id""")
def context_relevancy(spark, sf_dir):
    rows = chunk.sentences(_contexts(spark, sf_dir).withColumn("_vb", hashed_embedding(F.col("question"))), "context")
    return _similar(rows.withColumn("_va", hashed_embedding(F.col("content")))).groupBy("conv_id").agg(F.round(F.avg("similarity"), 5).alias("context_relevancy"))


@query(f"""WITH f AS ({_FAITH} SELECT conv_id, turn, avg(CASE WHEN s > 0.4 THEN 1.0 ELSE 0.0 END) AS faithfulness FROM per GROUP BY ALL),
r AS ({_RELEVANCY} SELECT conv_id, turn, similarity AS answer_relevancy FROM cs)
SELECT count(*)::BIGINT AS num_examples, round(avg(faithfulness), 4)::DOUBLE AS faithfulness, round(avg(answer_relevancy), 4)::DOUBLE AS answer_relevancy FROM f FULL JOIN r USING (conv_id, turn)""")
def batch_evaluate(spark, sf_dir):
    both = _faithfulness(spark, sf_dir).join(_answer_relevancy(spark, sf_dir), ["conv_id", "turn"], "full")
    return both.agg(F.count(F.lit(1)).alias("num_examples"), F.round(F.avg("faithfulness"), 4).alias("faithfulness"), F.round(F.avg("answer_relevancy"), 4).alias("answer_relevancy"))


_METRICS = "value / 100 AS faithfulness, CASE WHEN event_id % 2 = 0 THEN value / 200 END AS context_precision, (event_id % 10) / 10.0::DOUBLE AS answer_relevancy"


@query(f"""SELECT event_id, round(list_avg(list_filter([faithfulness, answer_relevancy, context_precision], lambda x: x IS NOT NULL)), 6)::DOUBLE AS overall FROM (SELECT event_id, {_METRICS} FROM events)""")
def overall_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("event_id", F.round(evaluate.overall("faithfulness", "answer_relevancy", "context_precision"), 6).alias("overall"))


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("value") / 100).alias("faithfulness"), F.when(F.col("event_id") % 2 == 0, F.col("value") / 200).alias("context_precision"), ((F.col("event_id") % 10) / 10.0).alias("answer_relevancy"))


@query("""SELECT event_type AS metric, count(*)::BIGINT AS n, round(avg(value), 4)::DOUBLE AS mean, round(stddev_pop(value), 4)::DOUBLE AS std, round(quantile_cont(value, 0.5), 4)::DOUBLE AS p50, round(quantile_cont(value, 0.95), 4)::DOUBLE AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def benchmark_stats(spark, sf_dir):
    rows = evaluate.summarized(table(spark, sf_dir, "events"), "value", ["event_type"])
    return rows.select(F.col("event_type").alias("metric"), "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p50", "p95")])


@query("""WITH m AS (SELECT 'set' || (user_id % 5) AS dataset, CASE event_type WHEN 'click' THEN 'latency' ELSE event_type END AS metric, avg(value) AS mean FROM events GROUP BY ALL)
SELECT dataset, metric, round(mean, 4)::DOUBLE AS mean, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'latency' THEN -round(mean, 6) ELSE round(mean, 6) END DESC, dataset) = 1 AS is_best FROM m""")
def compare_benchmarks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("set"), (F.col("user_id") % 5).cast("string")).alias("dataset"), F.when(F.col("event_type") == "click", "latency").otherwise(F.col("event_type")).alias("metric"), "value")
    return evaluate.compared(rows, "dataset", "metric", "value").withColumn("mean", F.round("mean", 4))


@query(f"""SELECT event_type, count(*)::BIGINT AS total, count(context_precision)::BIGINT AS successful, (count(*) - count(context_precision))::BIGINT AS failed, round(avg(faithfulness), 4)::DOUBLE AS faithfulness, round(avg(context_precision), 4)::DOUBLE AS context_precision
FROM (SELECT event_type, {_METRICS} FROM events) GROUP BY event_type""")
def eval_summary(spark, sf_dir):
    on = F.count("context_precision")
    return _scores(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), on.alias("successful"), (F.count(F.lit(1)) - on).alias("failed"), F.round(F.avg("faithfulness"), 4).alias("faithfulness"), F.round(F.avg("context_precision"), 4).alias("context_precision"))


@query("SELECT coalesce(CASE WHEN user_id % 7 <> 0 THEN user_id::VARCHAR END, 'unknown') AS evaluator, count(*)::BIGINT AS n, round(avg(value), 6)::DOUBLE AS mean FROM events GROUP BY 1")
def human_eval_stats(spark, sf_dir):
    evaluator = F.coalesce(F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("string")), F.lit("unknown"))
    return table(spark, sf_dir, "events").groupBy(evaluator.alias("evaluator")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT l.quality::BIGINT AS batch_id, count(*)::BIGINT AS n, round(avg(e.value), 4)::DOUBLE AS mean FROM events e JOIN labels l ON l.doc_id = e.event_id GROUP BY l.quality")
def human_eval_by_batch(spark, sf_dir):
    """Evaluations get their item's batch by a join."""
    batches = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), F.col("quality").cast("long").alias("batch_id"))
    return table(spark, sf_dir, "events").join(batches, "event_id").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(f"SELECT round(avg(faithfulness), 3)::DOUBLE AS faithfulness, round(avg(context_precision), 3)::DOUBLE AS context_precision, round(avg(answer_relevancy), 3)::DOUBLE AS answer_relevancy FROM (SELECT {_METRICS} FROM events)")
def dashboard_means(spark, sf_dir):
    return _scores(spark, sf_dir).agg(*[F.round(F.avg(m), 3).alias(m) for m in ("faithfulness", "context_precision", "answer_relevancy")])


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 4)::DOUBLE AS {n}" for q, n in ((0.0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "high"))) + " FROM events GROUP BY event_type")
def score_distribution(spark, sf_dir):
    rows = evaluate.distribution(table(spark, sf_dir, "events"), "value", ["event_type"])
    return rows.select("event_type", *[F.round(c, 4).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query("""WITH p AS (SELECT event_type, epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS ms FROM events)
SELECT event_type AS operation, count(*)::BIGINT AS times, round(sum(coalesce(ms, 0)) / 1000, 1)::DOUBLE AS seconds FROM p GROUP BY event_type""")
def timing_summary(spark, sf_dir):
    """An event ends what the user's last event of its type began; the first one has nothing to end: 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").withColumn("ms", at - F.lag(at).over(w))
    return rows.groupBy(F.col("event_type").alias("operation")).agg(F.count(F.lit(1)).alias("times"), F.round(F.sum(F.coalesce("ms", F.lit(0))) / 1000, 1).alias("seconds"))


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts))::BIGINT AS started_us, count(*)::BIGINT AS n_events FROM s GROUP BY user_id, s"""


@query(_SESSIONS)
def session_stats(spark, sf_dir):
    rows = streams.sessions(table(spark, sf_dir, "events"))
    return rows.select("user_id", F.unix_micros("started").alias("started_us"), "n_events")


_DIMS = "SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::BIGINT - 1 AS dim FROM embeddings"
_QUANT = f"WITH l AS ({_DIMS}), r AS (SELECT dim, min(x) AS mn, max(x) AS mx FROM l GROUP BY dim), q AS (SELECT vec_id, dim, mn, mx, x, trunc((x - mn) / CASE WHEN mx = mn THEN 1 ELSE mx - mn END * 255)::INT AS code FROM l JOIN r USING (dim))"


def _long(rows, column, name):
    return rows.select("vec_id", F.posexplode(column).alias("dim", name)).withColumn("dim", F.col("dim").cast("long"))


@query(f"{_QUANT} SELECT vec_id, dim, code::BIGINT AS code FROM q")
def quantize_scalar(spark, sf_dir):
    return _long(quantize.quantize(table(spark, sf_dir, "embeddings"), "scalar"), "codes", "code").withColumn("code", F.col("code").cast("long"))


@query(f"{_QUANT} SELECT vec_id, dim, round(code / 255.0::DOUBLE * CASE WHEN mx = mn THEN 1 ELSE mx - mn END + mn, 6)::DOUBLE AS x FROM q")
def dequantize_scalar(spark, sf_dir):
    rows = quantize.quantize(table(spark, sf_dir, "embeddings"), "scalar").withColumn("back", quantize.restored(F.col("codes"), F.col("bounds")))
    return _long(rows, "back", "x").withColumn("x", F.round("x", 6))


@query(f"{_QUANT} SELECT vec_id, least(dim // 16, 3)::BIGINT AS part, list(code ORDER BY dim)::VARCHAR AS codes FROM q GROUP BY ALL")
def quantize_product(spark, sf_dir):
    rows = quantize.quantize(table(spark, sf_dir, "embeddings"), "product").select("vec_id", F.posexplode("parts").alias("part", "c"))
    text = F.concat(F.lit("["), F.array_join(F.transform("c", lambda x: x.cast("string")), ", "), F.lit("]"))
    return rows.select("vec_id", F.col("part").cast("long").alias("part"), text.alias("codes"))


@query(f"{_QUANT} SELECT vec_id, dim, round(code / 255.0::DOUBLE * CASE WHEN mx = mn THEN 1 ELSE mx - mn END + mn, 6)::DOUBLE AS x FROM q")
def dequantize_product(spark, sf_dir):
    rows = quantize.quantize(table(spark, sf_dir, "embeddings"), "product").withColumn("back", quantize.restored(F.flatten("parts"), F.col("bounds")))
    return _long(rows, "back", "x").withColumn("x", F.round("x", 6))


@query(f"SELECT vec_id, dim, (x > 0)::BIGINT AS bit, (CASE WHEN x > 0 THEN 1 ELSE -1 END)::BIGINT AS back FROM ({_DIMS})")
def quantize_binary(spark, sf_dir):
    rows = quantize.quantize(table(spark, sf_dir, "embeddings"), "binary")
    rows = rows.withColumn("both", F.arrays_zip(F.col("codes").alias("bit"), quantize.from_binary(F.col("codes")).alias("back")))
    return _long(rows, "both", "v").select("vec_id", "dim", F.col("v.bit").cast("long").alias("bit"), F.col("v.back").cast("long").alias("back"))


def _streamed(spark, frame, mode: str):
    """Run a stream over all that is there, in small batches, and give what its sink holds; a batch that is run again replaces its rows."""
    path = _place(spark)

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    frame.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _stream(spark, sf_dir, name):
    """A table as a stream of four files."""
    rows = table(spark, sf_dir, name)
    path = f"{_place(spark)}/{name}"
    rows.repartition(4).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT user_id::VARCHAR AS evaluator_id, count(*)::BIGINT AS n, round(avg(value), 6)::DOUBLE AS mean FROM events GROUP BY user_id")
def stream_eval_stats(spark, sf_dir):
    """Running statistics of a stream; the last batch holds all evaluators."""
    rows = streams.running_scores(_stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("evaluator_id"), F.col("value").alias("score")))
    held = _streamed(spark, rows, "complete")
    return held.join(held.agg(F.max("batch").alias("batch")), "batch").select("evaluator_id", "n", F.round("mean", 6).alias("mean"))


@query("SELECT conv_id, turn, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS back FROM conversations) WHERE back <= 3")
def stream_memory(spark, sf_dir):
    """The newest three turns, kept as state of a stream; of each conversation the last batch counts."""
    from pyspark.sql import Window

    rows = streams.remembered(_stream(spark, sf_dir, "conversations"), 3)
    held = _streamed(spark, rows, "update")
    last = held.withColumn("_last", F.max("batch").over(Window.partitionBy("conv_id"))).where("batch = _last")
    return last.select("conv_id", "turn", "back")


# --- driver data, no operator of the reference: windows over events and a star join ---


@query("SELECT event_type, epoch_ms(date_trunc('day', ts))::BIGINT AS started_ms, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def driver_daily_events(spark, sf_dir):
    rows = streams.windows(table(spark, sf_dir, "events"))
    return rows.select("event_type", F.unix_millis("started").alias("started_ms"), "n")


@query("""SELECT n_name, count(*)::BIGINT AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def driver_revenue_by_nation(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).cast("double").alias("revenue"))



