"""Queries on systems compiled from settings."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import system
from ..sources import files
from .common import query, words
from .retrieval import _FIRST, _VARIANTS, _hashed_sql, _texts, _top
from .tables import _place
from .text import _PARTS, OVERLAP

STRATEGIES = ("none", "llm_rewrite", "expansion", "hyde", "decomposition")
_SETTINGS = """
text_splitter:
  type: fixed_size
  chunk_size: 1000
  chunk_overlap: 100
vector_store:
  type: flat
retrieval:
  k: 3
"""
_CHUNKS = "c AS MATERIALIZED (SELECT doc_id * 1000000 + i AS id, doc_id, substr(text, i * 900 + 1, 1000) AS text FROM documents, unnest(range((length(text) + 899) // 900)) AS u(i))"
_ANSWER = f"CASE WHEN trim({_FIRST}) <> '' THEN {_FIRST} ELSE text END"
_ASKED = f"""v AS (SELECT item_id, s, CASE s WHEN 0 THEN [text] WHEN 1 THEN [CASE WHEN length(trim({_FIRST})) > 10 THEN trim({_FIRST}) ELSE text END]
  WHEN 2 THEN list_filter([text, {_VARIANTS}], lambda x: x IS NOT NULL)[1:3] WHEN 3 THEN [{_ANSWER}] ELSE ([text] || {_PARTS})[1:3] END AS v FROM benchmark, unnest(range(5)) AS u(s)),
y AS MATERIALIZED (SELECT (item_id * 5 + s) * 16 + generate_subscripts(v, 1) - 1 AS query_id, unnest(v) AS text FROM v)"""
_HITS = f"""{_CHUNKS}, {_ASKED}, {_hashed_sql('e', 'id', 'c')}, {_hashed_sql('h', 'query_id', 'y')},
dense AS (SELECT query_id, id, round(sum(hb.c * eb.c) / (any_value(hl.l) * any_value(el.l)), 6) AS score FROM hb JOIN eb USING (b) JOIN hl USING (query_id) JOIN el USING (id) GROUP BY ALL),
t AS (SELECT query_id // 16 AS q, query_id % 16 * 1000 + rank AS ord, c.text AS content, id, c.doc_id, score FROM {_top('dense', 3)} JOIN c USING (id)),
m AS (SELECT q, content, min(ord) AS position, arg_max(id, ord) AS chunk_id, arg_max(doc_id, ord) AS id, arg_max(score, ord) AS score FROM t GROUP BY q, content)"""


def _settings(**more) -> dict:
    return files.settings(_SETTINGS) | more


def _each(spark, sf_dir, make) -> DataFrame:
    """The results of all strategies, one under the other."""
    q, d = _texts(spark, sf_dir)
    d = d.select("id", "text")
    systems = {s: system.compiled(make(s)) for s in STRATEGIES}
    # all split and embed alike, so vectors are made once
    vectors, path = systems["none"].chunks(d).select("chunk_id", "vector"), _place(spark)
    vectors.write.parquet(path)
    vectors = spark.read.schema(vectors.schema).parquet(path)
    out = [own.retrieve(q, d, vectors=vectors).withColumn("strategy", F.lit(s)) for s, own in systems.items()]
    rows = functools.reduce(DataFrame.union, out)
    return rows.select("strategy", "query_id", "chunk_id", "id", F.md5("content").alias("content"), "score", "rank")


_STRATEGY = "CASE q % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STRATEGIES)) + " END"


@query(f"""WITH {_HITS}
SELECT {_STRATEGY} AS strategy, q // 5 AS query_id, chunk_id, id, md5(content) AS content, score, (row_number() OVER (PARTITION BY q ORDER BY position))::BIGINT AS rank FROM m""")
def system_strategies(spark, sf_dir):
    """One system for each strategy: variants fanned out, hits brought together."""
    return _each(spark, sf_dir, lambda s: _settings(strategy=s))


@query(f"""WITH {_HITS},
p AS (SELECT m.*, content AS text, b.text AS question, list_distinct({words('lower(b.text)')}) AS qw, list_distinct({words('lower(content)')}) AS tw FROM m JOIN benchmark b ON b.item_id = q // 5),
s AS (SELECT *, round({OVERLAP}, 6)::DOUBLE AS relevance FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY relevance DESC, position) AS rank FROM s),
f AS (SELECT *, sum(length(content) // 4) OVER (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM r)
SELECT {_STRATEGY} AS strategy, q // 5 AS query_id, chunk_id, id, md5(content) AS content, relevance AS score, rank::BIGINT AS rank FROM f WHERE used <= 600""")
def system_reranked(spark, sf_dir):
    """The same, reranked and fitted into a budget of 600 tokens."""
    return _each(spark, sf_dir, lambda s: _settings(strategy=s, reranker={"type": "simple"}, context_compression={"type": "prefix", "max_tokens": 600}))

