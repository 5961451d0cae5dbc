"""Queries on texts: chunks, scalars, rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from ..operators import chunk, rewrite
from ..operators.hooks import first_sentence
from .common import TOKEN, query, quoted, table, words

LONG = lambda *names: [F.col(n).cast("long").alias(n) for n in names]


@query("""
SELECT doc_id, source, i::BIGINT AS chunk_ord, (i * 450)::BIGINT AS start_index, (i * 450 + 500)::BIGINT AS end_index, substr(text, (i * 450 + 1)::BIGINT, 500) AS content
FROM documents, unnest(range((length(text) + 449) // 450)) AS u(i)
""")
def chunk_fixed(spark, sf_dir):
    rows = chunk.fixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", *LONG("chunk_ord", "start_index", "end_index"), "content")


_SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_STRIPPED = r"regexp_replace(raw, '^\s+|\s+$', '', 'g')"


@query(f"""
SELECT doc_id, (i - 1)::BIGINT AS sentence_index, {_STRIPPED} AS content
FROM (SELECT doc_id, unnest({_SENTENCES}) AS raw, generate_subscripts({_SENTENCES}, 1) AS i FROM documents)
WHERE {_STRIPPED} <> ''
""")
def chunk_sentence(spark, sf_dir):
    return chunk.sentences(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *LONG("sentence_index"), "content")


@query("SELECT source, sum((length(text) + 449) // 450)::BIGINT AS chunks, count(*)::BIGINT AS documents FROM documents GROUP BY source")
def chunks_per_document(spark, sf_dir):
    rows = chunk.fixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_ord") == 0).alias("documents"))


@query(f"""
SELECT conv_id, turn, (i - 1)::BIGINT AS sentence_index, {_STRIPPED} AS content
FROM (SELECT conv_id, turn, unnest({_SENTENCES}) AS raw, generate_subscripts({_SENTENCES}, 1) AS i FROM conversations WHERE role = 'assistant')
WHERE {_STRIPPED} <> ''
""")
def split_statements(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return chunk.sentences(rows).select("conv_id", "turn", *LONG("sentence_index"), "content")


@query(f"SELECT page_id, ({' OR '.join('regexp_matches(html, ' + quoted([p]) + ')' for p in C.CODE_PATTERNS)}) AS is_code FROM pages")
def detect_code(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.looks_like_code(F.col("html")).alias("is_code"))


def _pages_as_code(spark, sf_dir, kind):
    rows = table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("><"), F.lit(">\n<")).alias("text"))
    return chunk.code(rows, kind=kind).select("page_id", "type", *LONG("chunk_ord", "start_index", "end_index"), "content")


@query("""
WITH RECURSIVE l AS (SELECT page_id, string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)) AS lines FROM pages),
fold AS (
  SELECT page_id, 0 AS i, 0 AS first, 0 AS held, false AS cut FROM l
  UNION ALL
  SELECT f.page_id, f.i + 1, CASE WHEN f.cut THEN f.i ELSE f.first END,
    CASE WHEN f.cut THEN 0 ELSE f.held END + length(l.lines[f.i + 1]) + 1,
    CASE WHEN f.cut THEN 0 ELSE f.held END + length(l.lines[f.i + 1]) + 1 > 1000
  FROM fold f JOIN l USING (page_id) WHERE f.i < len(l.lines)),
ends AS (SELECT page_id, first, i FROM fold JOIN l USING (page_id) WHERE i > 0 AND (cut OR i = len(lines)))
SELECT page_id, 'python_code' AS type, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::BIGINT AS chunk_ord,
  first::BIGINT AS start_index, i::BIGINT AS end_index, array_to_string(lines[first + 1:i], chr(10)) AS content
FROM ends JOIN l USING (page_id)
""")
def chunk_code_python(spark, sf_dir):
    return _pages_as_code(spark, sf_dir, "python_code")


@query()
def chunk_code_general(spark, sf_dir):
    return _pages_as_code(spark, sf_dir, "code")


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")


_Q = "(SELECT concat_ws('-', conv_id, turn) AS query_id, text FROM conversations WHERE role = 'user')"
_VARIANTS = ", ".join(
    f"CASE WHEN contains(lower(text), '{t}') AND replace(lower(text), '{t}', '{s}') <> lower(text) THEN replace(lower(text), '{t}', '{s}') END" for t, ss in C.SYNONYMS for s in ss
)


@query(f"""
WITH v AS (SELECT query_id, list_filter([text, {_VARIANTS}], lambda x: x IS NOT NULL)[1:3] AS v FROM {_Q})
SELECT query_id, (generate_subscripts(v, 1) - 1)::BIGINT AS variant, unnest(v) AS text FROM v
""")
def expand_query(spark, sf_dir):
    return rewrite.exploded(_questions(spark, sf_dir), rewrite.expansions(F.col("text"))).withColumn("variant", F.col("variant").cast("long"))


_PARTS = " || ".join(
    rf"CASE WHEN contains(lower(text), ' {c} ') THEN list_filter(list_transform(string_split(text, ' {c} '), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') ELSE [] END" for c in C.CONJUNCTIONS
)


@query(f"""
WITH v AS (SELECT query_id, ([text] || {_PARTS})[1:3] AS v FROM {_Q})
SELECT query_id, (generate_subscripts(v, 1) - 1)::BIGINT AS variant, unnest(v) AS text FROM v
""")
def decompose_query(spark, sf_dir):
    return rewrite.exploded(_questions(spark, sf_dir), rewrite.parts(F.col("text"))).withColumn("variant", F.col("variant").cast("long"))


_KEYS = rf"list_filter(regexp_extract_all(lower(text), '{TOKEN}+'), lambda w: length(w) > 2 AND NOT list_contains([{quoted(C.STOP_WORDS)}], w))"


@query(f"SELECT item_id, array_to_string({_KEYS}, ' ') AS keywords FROM benchmark")
def extract_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.keywords(F.col("text")), " ").alias("keywords"))


def pairs(spark, sf_dir):
    """Each user turn with each other turn of its conversation: question and candidate text."""
    turns = table(spark, sf_dir, "conversations")
    q = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("q_turn"), F.col("text").alias("question"))
    return q.join(turns.select("conv_id", "turn", "text"), "conv_id").where("turn != q_turn")


PAIRS = "(SELECT q.conv_id, q.turn AS q_turn, q.text AS question, t.turn, t.text FROM conversations q JOIN conversations t USING (conv_id) WHERE q.role = 'user' AND q.turn <> t.turn)"


@query(rf"""
WITH p AS (SELECT *, {_KEYS.replace('lower(text)', 'lower(question)')} AS ks FROM {PAIRS})
SELECT conv_id, q_turn, turn, round(CASE WHEN len(ks) > 0 THEN len(list_filter(ks, lambda k: contains(lower(text), k))) / len(ks) ELSE 0 END, 6)::DOUBLE AS keyword_score FROM p
""")
def keyword_score(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("ks", X.keywords(F.col("question")))
    return rows.select("conv_id", "q_turn", "turn", F.round(X.keyword_score(F.col("ks"), F.lower("text")), 6).alias("keyword_score"))


OVERLAP = rf"""CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, tw)) / len(qw) ELSE 0 END + CASE WHEN contains(lower(text), lower(question)) THEN 0.5 ELSE 0 END"""


@query(rf"""
WITH p AS (SELECT *, list_distinct({words('lower(question)')}) AS qw, list_distinct({words('lower(text)')}) AS tw FROM {PAIRS}),
s AS (SELECT conv_id, q_turn, turn, round({OVERLAP}, 6)::DOUBLE AS relevance_score FROM p)
SELECT *, row_number() OVER (PARTITION BY conv_id, q_turn ORDER BY relevance_score DESC, turn)::BIGINT AS rank FROM s
""")
def rerank_simple(spark, sf_dir):
    from pyspark.sql import Window

    rows = pairs(spark, sf_dir).select("conv_id", "q_turn", "turn", F.round(X.overlap_score(F.col("question"), F.col("text")), 6).alias("relevance_score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "q_turn").orderBy(F.desc("relevance_score"), "turn")).cast("long"))


@query("""SELECT conv_id, q_turn, turn, 0.5::DOUBLE AS relevance_score, row_number() OVER (PARTITION BY conv_id, q_turn ORDER BY turn)::BIGINT AS rank
FROM (SELECT q.conv_id, q.turn AS q_turn, t.turn FROM conversations q JOIN conversations t USING (conv_id) WHERE q.role = 'user' AND q.turn <> t.turn)""")
def rerank_model_fallback(spark, sf_dir):
    from pyspark.sql import Window

    from ..operators.hooks import component

    score = component("reranker", "constant")
    rows = pairs(spark, sf_dir).select("conv_id", "q_turn", "turn", score(F.col("question"), F.col("text")).cast("double").alias("relevance_score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "q_turn").orderBy(F.desc("relevance_score"), "turn")).cast("long"))


@query("SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(rf"""
SELECT doc_id, length(text)::BIGINT AS total_length, len({words('text')})::BIGINT AS word_count,
  (length(text) - length(replace(text, '.', '')) + 1)::BIGINT AS sentence_count,
  round(len({words('text')}) / greatest(length(text) - length(replace(text, '.', '')) + 1, 1), 6)::DOUBLE AS avg_sentence_length FROM documents
""")
def text_stats(spark, sf_dir):
    stats = X.stats(F.col("text"))
    stats["avg_sentence_length"] = F.round(stats["avg_sentence_length"], 6)
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in stats.items()])


_COMPLEX = rf"""CASE WHEN len(ws) > 0 THEN length(array_to_string(ws, '')) / len(ws) * 0.7::DOUBLE + (length(text) - length(translate(text, '.,;:!?', ''))) / len(ws) * 0.3::DOUBLE ELSE 0 END"""


@query(rf"SELECT doc_id, round({_COMPLEX}, 6)::DOUBLE AS complexity FROM (SELECT doc_id, text, {words('text')} AS ws FROM documents)")
def text_complexity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.complexity(F.col("text")), 6).alias("complexity"))


_PERF = "greatest(0, 1 - coalesce({t}, 1.0) / 10) * 0.6::DOUBLE + greatest(0, 1 - coalesce({m}, 0.5::DOUBLE)) * 0.4::DOUBLE"


@query(f"SELECT event_id, round({_PERF.format(t='value', m='NULL')}, 6)::DOUBLE AS performance_score FROM events")
def performance_score(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(X.performance_score(F.col("value"), F.lit(None).cast("double")), 6).alias("performance_score"))


@query(rf"""
WITH d AS (SELECT doc_id, {_COMPLEX} AS c, (doc_id % 10) / 10.0::DOUBLE AS m FROM (SELECT doc_id, text, {words('text')} AS ws FROM documents)),
p AS (SELECT doc_id, c, {_PERF.format(t='NULL', m='m')} AS p FROM d)
SELECT doc_id, greatest(100, least(2000, trunc(500.0::DOUBLE * CASE WHEN c > 0.7 THEN 0.8::DOUBLE WHEN c < 0.3 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN p < 0.5 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END)::INT))::BIGINT AS chunk_size FROM p
""")
def optimal_chunk_size(spark, sf_dir):
    memory = (F.col("doc_id") % 10) / F.lit(10.0)
    return table(spark, sf_dir, "documents").select("doc_id", X.optimal_chunk_size(X.complexity(F.col("text")), X.performance_score(F.lit(None).cast("double"), memory)).alias("chunk_size"))


@query(rf"""
WITH c AS (SELECT conv_id, array_to_string(list(text ORDER BY turn), ' ') AS context FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, turn, round(len({words('text')}) / greatest(1, len({words('context')})), 6)::DOUBLE AS token_efficiency FROM conversations JOIN c USING (conv_id) WHERE role = 'assistant'
""")
def token_efficiency(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    context = turns.where("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("context"))
    rows = turns.where("role = 'assistant'").join(context, "conv_id")
    return rows.select("conv_id", "turn", F.round(F.size(X.words(F.col("text"))) / F.greatest(F.lit(1), F.size(X.words(F.col("context")))), 6).alias("token_efficiency"))


@query("""
WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations WHERE role <> 'user' GROUP BY conv_id),
q AS (SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, 'Context:' || chr(10) || array_to_string(list_transform(texts, lambda t, i: '[Context ' || i || ']: ' || t), chr(10)) || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer:' AS prompt
FROM c JOIN q USING (conv_id)
""")
def build_prompt(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    c = turns.where("role != 'user'").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    q = turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    return c.join(q, "conv_id").select("conv_id", X.prompt(F.col("texts"), F.col("question")).alias("prompt"))


def _has(*parts):
    return "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in parts) + ")"


@query(f"""SELECT query_id, CASE WHEN {_has('python', 'code')} THEN '' WHEN {_has('function', 'def ', 'import', 'class')} THEN 'Python: '
WHEN {_has('javascript', 'js', 'node')} THEN 'JavaScript: ' WHEN {_has('java', 'public class')} THEN 'Java: ' ELSE '' END || text AS text FROM {_Q}""")
def enhance_code_query(spark, sf_dir):
    return _questions(spark, sf_dir).select("query_id", X.language_hint(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, (regexp_replace(text, '^\s+|\s+$', '', 'g') = '' OR
CASE WHEN length(text) > 0 THEN (length(text) - length(replace(text, substr(text, 1, 20), ''))) / length(substr(text, 1, 20)) ELSE 0 END > 3) AS refused FROM documents""")
def repetition_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.repeats_itself(F.col("text")).alias("refused"))


@query("SELECT event_id, CASE WHEN value / 100 >= 0.8 THEN 'green' WHEN value / 100 >= 0.6 THEN 'yellow' ELSE 'red' END AS band FROM events")
def score_band(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.score_band(F.col("value") / 100).alias("band"))


_ANSWER = "CASE event_id % 4 WHEN 0 THEN round(value, 2)::DECIMAL(9,2)::VARCHAR WHEN 1 THEN 'about ' || event_type WHEN 2 THEN 'Yes, ' || event_type ELSE '' END"


@query(f"""SELECT event_id, coalesce(CASE WHEN regexp_matches(replace(a, '.', ''), '^[0-9]+$') THEN try_cast(a AS DOUBLE) END, 0.5) AS score, contains(upper(a), 'YES') AS is_yes FROM (SELECT event_id, {_ANSWER} AS a FROM events)""")
def parse_score(spark, sf_dir):
    answer = (
        F.when(F.col("event_id") % 4 == 0, F.round("value", 2).cast("decimal(9,2)").cast("string"))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("about "), "event_type"))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("Yes, "), "event_type"))
        .otherwise("")
    )
    return table(spark, sf_dir, "events").withColumn("a", answer).select("event_id", X.parse_score(F.col("a")).alias("score"), X.says_yes(F.col("a")).alias("is_yes"))


@query("SELECT doc_id, i::BIGINT AS chunk_ord, source || '.txt:chunk' || i AS label FROM documents, unnest(range((length(text) + 449) // 450)) AS u(i)")
def source_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("/data/"), "source", F.lit(".txt")).alias("path"))
    return chunk.fixed(docs).select("doc_id", *LONG("chunk_ord"), F.concat(X.base_name(F.col("path")), F.lit(":chunk"), F.col("chunk_ord").cast("string")).alias("label"))


@query(rf"SELECT query_id, CASE WHEN length(s) > 10 THEN s ELSE text END AS text FROM (SELECT query_id, text, regexp_replace(({_SENTENCES})[1], '^\s+|\s+$', '', 'g') AS s FROM {_Q})")
def rewrite_guard(spark, sf_dir):
    return _questions(spark, sf_dir).select("query_id", rewrite.accepted(F.col("text"), first_sentence(F.col("text"))).alias("text"))
