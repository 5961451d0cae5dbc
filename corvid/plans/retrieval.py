"""Queries on search, fusion, reranking, compression and memory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from ..operators import compress, memory, rewrite, search, tfidf
from ..operators.hooks import first_sentence, hashed_embedding
from .common import TOKEN, query, quoted, table, words
from .tables import _place
from .text import OVERLAP

#: Every vector whose id is divisible by 100 is a question, against all vectors.
_VECTORS = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
p AS (SELECT query_id, id, label, q.v AS a, c.v AS b FROM q, c),
s AS (SELECT query_id, id, label, round(list_sum(list_transform(range(1, 65), lambda i: (a[i] - b[i]) * (a[i] - b[i]))), 6) AS l2,
  round(list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])) / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))), 6) AS cosine FROM p)
"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    corpus = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), corpus


def _ranked(value: str, order: str, where: str = "true", extra: str = "") -> str:
    return f"WITH {_VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS rank FROM s WHERE {where}) SELECT query_id, id, {value} AS score, rank::BIGINT AS rank{extra} FROM r WHERE rank <= 5"


@query(_ranked("l2", "l2"))
def l2_topk(spark, sf_dir):
    return search.top_k(*_vectors(spark, sf_dir), kind="l2")


@query(_ranked("cosine", "cosine DESC"))
def cosine_topk(spark, sf_dir):
    return search.top_k(*_vectors(spark, sf_dir), kind="cosine")


@query(f"""WITH {_VECTORS}, x AS (SELECT query_id, label, round(greatest(0, least(1, cosine)) * 1000000)::BIGINT AS micro FROM s)
SELECT query_id, label::BIGINT AS label, ((2 * sum(micro) + 10 * count(*)) // (20 * count(*)))::DOUBLE / 100000 AS similarity FROM x GROUP BY ALL""")
def clamped_cosine(spark, sf_dir):
    """Mean clamped similarity of each question with all rows, by label."""
    mean = F.expr("((2 * micro + 10 * n) div (20 * n)) / 100000.0D")  # five digits, half up
    return search.label_means(*_vectors(spark, sf_dir)).select("query_id", "label", mean.alias("similarity"))


@query(_ranked("l2", "l2", extra=", label::BIGINT AS label") + " AND label < 5")
def vector_search_postfilter(spark, sf_dir):
    q, c = _vectors(spark, sf_dir)
    return search.filtered_after(q, c, F.col("label") < 5).select("query_id", "id", "score", "rank", "label")


@query(_ranked("l2", "l2", "label < 5", ", label::BIGINT AS label"))
def vector_search_prefilter(spark, sf_dir):
    q, c = _vectors(spark, sf_dir)
    return search.filtered_before(q, c, F.col("label") < 5).select("query_id", "id", "score", "rank", "label")


@query()
def ann_lsh_topk(spark, sf_dir):
    return search.approximate(*_vectors(spark, sf_dir))


@query("""
SELECT event_id, event_type, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 1.0 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6)::DOUBLE AS scaled
FROM events WINDOW w AS (PARTITION BY user_id)
""")
def minmax_normalize(spark, sf_dir):
    rows = search.min_max(table(spark, sf_dir, "events"), "value", "scaled", by="user_id")
    return rows.select("event_id", "event_type", F.round("scaled", 6).alias("scaled"))


# --- text search: benchmark items are the questions, all documents the corpus ---

def _texts(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")
    return q, d


def _grams(name: str, key: str, rel: str) -> str:
    return rf"""
{name}words AS (SELECT {key}, list_filter(regexp_extract_all(lower(text), '{TOKEN}{{2,}}'), lambda w: NOT list_contains([{quoted(C.STOP_WORDS)}], w)) AS ws FROM {rel}),
{name}tf AS (SELECT {key}, term, count(*) AS tf FROM (
  SELECT {key}, unnest(ws || list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM {name}words) GROUP BY ALL)"""


_TFIDF = f"""
{_grams('d', 'id', '(SELECT doc_id AS id, text FROM documents)')},
{_grams('q', 'query_id', '(SELECT item_id AS query_id, text FROM benchmark)')},
st AS (SELECT term, sum(tf) AS total, count(*) AS df FROM dtf GROUP BY term ORDER BY total DESC, term LIMIT 10000),
idf AS (SELECT term, total::BIGINT AS total, df::BIGINT AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM st),
dr AS (SELECT id, term, tf * idf AS w FROM dtf JOIN idf USING (term)),
dn AS (SELECT id, sqrt(sum(w * w)) AS n FROM dr GROUP BY id),
dw AS (SELECT id, term, w / n AS w FROM dr JOIN dn USING (id)),
qr AS (SELECT query_id, term, tf * idf AS w FROM qtf JOIN idf USING (term)),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qr GROUP BY query_id),
qw AS (SELECT query_id, term, w / n AS w FROM qr JOIN qn USING (query_id)),
sparse AS (SELECT query_id, id, round(sum(qw.w * dw.w), 6) AS score FROM qw JOIN dw USING (term) GROUP BY ALL)
"""


@query(f"WITH {_TFIDF} SELECT term, total, df, round(idf, 6)::DOUBLE AS idf FROM idf")
def term_stats(spark, sf_dir):
    _, d = _texts(spark, sf_dir)
    return tfidf.term_stats(d).select("term", "total", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_TFIDF} SELECT id, term, round(w, 6)::DOUBLE AS weight FROM dw")
def tfidf_weights(spark, sf_dir):
    _, d = _texts(spark, sf_dir)
    return tfidf.weights(d, tfidf.vocabulary(tfidf.term_stats(d)), "id").select("id", "term", F.round("weight", 6).alias("weight"))


def _top(rel: str, k: int, score: str = "score") -> str:
    return f"(SELECT query_id, id, {score}, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) AS rank FROM {rel}) WHERE rank <= {k})"


@query(f"WITH {_TFIDF} SELECT query_id, id, score, rank::BIGINT AS rank FROM {_top('sparse', 5)}")
def tfidf_search(spark, sf_dir):
    q, d = _texts(spark, sf_dir)
    return tfidf.search(q, d, 5)


def _hashed_sql(name: str, key: str, rel: str) -> str:
    return f"""
{name}b AS (SELECT {key}, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS b, count(*) AS c FROM (
  SELECT {key}, unnest(regexp_extract_all(lower(text), '{TOKEN}+')) AS tok FROM {rel}) GROUP BY ALL),
{name}l AS (SELECT {key}, sqrt(sum(c * c)) AS l FROM {name}b GROUP BY {key})"""


_DENSE_D = _hashed_sql("e", "id", "(SELECT doc_id AS id, text FROM documents)")
_DENSE = f"""{_DENSE_D},
{_hashed_sql('h', 'query_id', '(SELECT item_id AS query_id, text FROM benchmark)')},
dense AS (SELECT query_id, id, round(sum(hb.c * eb.c) / (any_value(hl.l) * any_value(el.l)), 6) AS score FROM hb JOIN eb USING (b) JOIN hl USING (query_id) JOIN el USING (id) GROUP BY ALL)
"""


def _embedded(rows, key):
    return rows.select(key, hashed_embedding(F.col("text")).alias("vector"))


def dense_hits(q, d, k):
    """Best ``k`` documents by the stand-in embedding; those that share nothing are left out."""
    return search.top_k(_embedded(q, "query_id"), _embedded(d, "id"), k, "cosine").where("score > 0")


@query(f"WITH {_DENSE} SELECT query_id, id, score, rank::BIGINT AS rank FROM {_top('dense', 5)}")
def retrieve(spark, sf_dir):
    return dense_hits(*_texts(spark, sf_dir), 5)


@query(f"WITH {_DENSE} SELECT query_id, id, score AS hybrid_score, score AS dense_score, 0.0::DOUBLE AS sparse_score, rank::BIGINT AS rank FROM {_top('dense', 5)}")
def dense_only_search(spark, sf_dir):
    """What hybrid search gives before a sparse index exists: dense scores as they are."""
    rows = dense_hits(*_texts(spark, sf_dir), 5)
    return rows.select("query_id", "id", F.col("score").alias("hybrid_score"), F.col("score").alias("dense_score"), F.lit(0.0).alias("sparse_score"), "rank")


def _scaled(rel: str, score: str) -> str:
    return f"CASE WHEN max({score}) OVER w = min({score}) OVER w THEN 1.0 ELSE ({score} - min({score}) OVER w) / (max({score}) OVER w - min({score}) OVER w) END"


#: Every question with every document; what a side lacks is 0.
_PAIRS = """
f AS (SELECT b.item_id AS query_id, x.doc_id AS id, coalesce(d.score, 0) AS dr, coalesce(s.score, 0) AS sr FROM benchmark b CROSS JOIN documents x
  LEFT JOIN dense d ON d.query_id = b.item_id AND d.id = x.doc_id LEFT JOIN sparse s ON s.query_id = b.item_id AND s.id = x.doc_id)"""
_HYBRID = f"""WITH {_TFIDF}, {_DENSE}, {_PAIRS},
n AS (SELECT query_id, id, {_scaled('f', 'dr')} AS ds, {_scaled('f', 'sr')} AS ss FROM f WINDOW w AS (PARTITION BY query_id)),
hy AS (SELECT query_id, id, round(ds, 6)::DOUBLE AS dense_score, round(ss, 6)::DOUBLE AS sparse_score, round(ds * 0.5::DOUBLE + ss * 0.5::DOUBLE, 6)::DOUBLE AS hybrid_score FROM n)"""


def _sides(q, d, keys=None):
    """All documents with vectors and term weights, or numbers of the keywords ``keys``, each made once and written; questions alike, and makers of both scores."""
    corpus = d.select(F.col("id").cast("long").alias("id"), "text", hashed_embedding(F.col("text")).alias("vector")).where("text is not null")
    idf = {}
    if keys is None:
        idf = tfidf.vocabulary(tfidf.term_stats(d))
        corpus = tfidf.weighed(corpus, idf)
    else:
        corpus = search.with_keywords(corpus, keys)
    corpus = corpus.drop("text")
    path = _place(d.sparkSession)
    corpus.write.parquet(path)
    corpus = d.sparkSession.read.schema(corpus.schema).parquet(path)
    questions = q.select("query_id", "text", hashed_embedding(F.col("text")).alias("vector")).where("text is not null")
    dense = lambda rows: search.dense_scores(np.array(rows["vector"].tolist(), float), corpus.columns.index("vector"))
    terms = lambda rows: tfidf.sparse_scores(tfidf.Scorer(idf, rows["text"].tolist()), corpus.columns.index("terms"), corpus.columns.index("weights"))
    return questions, corpus, dense, terms


def _fused(spark, sf_dir, k, alpha=C.HYBRID_ALPHA):
    return search.fused(*_sides(*_texts(spark, sf_dir)), lambda a, b: a * alpha + b * (1 - alpha), ("dense_score", "sparse_score", "hybrid_score"), k)


@query(f"{_HYBRID} SELECT query_id, id, dense_score, sparse_score, hybrid_score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, id) AS rank FROM hy) WHERE rank <= 5")
def hybrid_search(spark, sf_dir):
    """Both scores are scaled over all documents."""
    return _fused(spark, sf_dir, 5)


_KEYS = rf"list_filter(regexp_extract_all(lower(b.text), '{TOKEN}+'), lambda w: length(w) > 2 AND NOT list_contains([{quoted(C.STOP_WORDS)}], w))"
_KSCORE = f"round(CASE WHEN len({_KEYS}) > 0 THEN len(list_filter({_KEYS}, lambda k: contains(lower(d.text), k))) / len({_KEYS}) ELSE 0 END, 6)::DOUBLE"


@query(f"""WITH {_DENSE},
k AS (SELECT b.item_id AS query_id, d.doc_id AS id, coalesce(t.score, 0) AS dr, {_KSCORE} AS kr FROM benchmark b CROSS JOIN documents d LEFT JOIN dense t ON t.query_id = b.item_id AND t.id = d.doc_id),
n AS (SELECT query_id, id, {_scaled('k', 'dr')} AS ds, {_scaled('k', 'kr')} AS ks FROM k WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT query_id, id, round(ds, 6)::DOUBLE AS dense_score, round(ks, 6)::DOUBLE AS keyword_score, round(ds * (1 + ks), 6)::DOUBLE AS boosted_score FROM n)
SELECT *, FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted_score DESC, id)::BIGINT AS rank FROM s) WHERE rank <= 5""")
def keyword_boost_search(spark, sf_dir):
    """Dense and keyword scores of all documents, scaled; keywords raise the dense score."""
    q, d = _texts(spark, sf_dir)
    found = X.keywords(F.col("text"))
    distinct = sorted(r[0] for r in q.select(F.explode(found).alias("key")).distinct().collect())
    questions, corpus, dense, _ = _sides(q, d, distinct)
    questions = questions.withColumn("keys", found)
    keys = lambda rows: search.keyword_scores([list(x) for x in rows["keys"]], corpus.columns.index("keys"), distinct)
    return search.fused(questions, corpus, dense, keys, lambda a, b: a * (1 + (C.KEYWORD_BOOST - 1) * b), ("dense_score", "keyword_score", "boosted_score"))


@query(f"""WITH {_TFIDF}, {_DENSE}, {_PAIRS},
s AS (SELECT query_id, id, dr::DOUBLE AS dense_score, sr::DOUBLE AS sparse_score, round(dr * (2.0::DOUBLE / 3) + sr * (1.0::DOUBLE / 3), 6)::DOUBLE AS combined_score FROM f)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, id)::BIGINT AS rank FROM s) WHERE rank <= 5""")
def multi_vector_search(spark, sf_dir):
    """Weights 2 and 1, scaled to a sum of 1, on the raw scores of all documents."""
    return search.fused(*_sides(*_texts(spark, sf_dir)), lambda a, b: a * (2.0 / 3) + b * (1.0 / 3), ("dense_score", "sparse_score", "combined_score"), scale=False)


_VARIANTS = ", ".join(
    f"CASE WHEN contains(lower(text), '{t}') AND replace(lower(text), '{t}', '{s}') <> lower(text) THEN replace(lower(text), '{t}', '{s}') END" for t, ss in C.SYNONYMS for s in ss
)


@query(f"""WITH x AS (SELECT item_id, list_filter([text, {_VARIANTS}], lambda v: v IS NOT NULL)[1:3] AS v FROM benchmark),
y AS (SELECT item_id, generate_subscripts(v, 1) - 1 AS variant, unnest(v) AS text FROM x),
{_DENSE_D},
{_hashed_sql('h', 'query_id', '(SELECT item_id * 10 + variant AS query_id, text FROM y)')},
dense AS (SELECT query_id, id, round(sum(hb.c * eb.c) / (any_value(hl.l) * any_value(el.l)), 6) AS score FROM hb JOIN eb USING (b) JOIN hl USING (query_id) JOIN el USING (id) GROUP BY ALL),
t AS (SELECT query_id // 10 AS item_id, (query_id % 10) * 100 + rank AS ord, d.text AS content, id, score FROM {_top('dense', 5)} JOIN documents d ON d.doc_id = id)
SELECT item_id::BIGINT AS item_id, md5(content) AS content, min(ord)::BIGINT AS position, arg_max(id, ord) AS id, arg_max(score, ord) AS score FROM t GROUP BY item_id, content""")
def multi_query_retrieve(spark, sf_dir):
    """Search with each question's variants; equal contents become one, at the first position with the last values."""
    q, d = _texts(spark, sf_dir)
    variants = rewrite.exploded(q, rewrite.expansions(F.col("text"))).select((F.col("query_id") * 10 + F.col("variant")).alias("query_id"), "text")
    hits = search.fetched(dense_hits(variants, d, 5), d.select("id", F.md5("text").alias("content")), "id", variants.count() * 5)
    rows = hits.select(F.floor(F.col("query_id") / 10).cast("long").alias("item_id"), ((F.col("query_id") % 10) * 100 + F.col("rank")).cast("long").alias("ord"), "content", "id", "score")
    return search.first_position_last_value(rows, ["item_id", "content"], "ord")


@query(f"""{_HYBRID},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, id) AS h FROM hy),
p AS (SELECT query_id, id, hybrid_score, d.text, b.text AS question, list_distinct({words('lower(b.text)')}) AS qw, list_distinct({words('lower(d.text)')}) AS tw
  FROM r JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = query_id WHERE h <= 10),
s AS (SELECT query_id, id, hybrid_score, round({OVERLAP}, 6)::DOUBLE AS relevance_score FROM p)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, id)::BIGINT AS rank FROM s) WHERE rank <= 5""")
def modular_retrieve(spark, sf_dir):
    """Fetch twice as many by hybrid search, rerank, keep the first five."""
    q, d = _texts(spark, sf_dir)
    hits = search.fetched(_fused(spark, sf_dir, 10).drop("rank"), d.select("id", "text"), "id", q.count() * 10).join(q.withColumnRenamed("text", "question"), "query_id")
    rows = hits.select("query_id", "id", "hybrid_score", F.round(X.overlap_score(F.col("question"), F.col("text")), 6).alias("relevance_score"))
    return search.best(rows, 5, "relevance_score", descending=True)


_FIRST = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1]"


@query(f"""WITH g AS (SELECT item_id AS query_id, CASE WHEN trim({_FIRST}) <> '' THEN {_FIRST} ELSE text END AS text FROM benchmark),
{_DENSE_D}, {_hashed_sql('h', 'query_id', 'g')},
dense AS (SELECT query_id, id, round(sum(hb.c * eb.c) / (any_value(hl.l) * any_value(el.l)), 6) AS score FROM hb JOIN eb USING (b) JOIN hl USING (query_id) JOIN el USING (id) GROUP BY ALL)
SELECT query_id, id, score, rank::BIGINT AS rank FROM {_top('dense', 5)}""")
def hyde_retrieve(spark, sf_dir):
    """Search with the (stand-in) generated answer; a blank one falls back to the question."""
    q, d = _texts(spark, sf_dir)
    answer = first_sentence(F.col("text"))
    return dense_hits(q.select("query_id", F.when(F.trim(answer) != "", answer).otherwise(F.col("text")).alias("text")), d, 5)


_STATUS = " OR ".join(f"contains(trim(lower(text)), '{g}')" for g in C.GREETINGS)


@query(f"""WITH {_DENSE},
h AS (SELECT query_id, count(*) AS n, round(2 - 2 * max(score), 6) AS best FROM {_top('dense', 5)} GROUP BY query_id),
q AS (SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN 'hi ' || item_id ELSE text END AS text FROM benchmark)
SELECT query_id, CASE WHEN ({_STATUS}) AND len({words('lower(text)')}) <= 3 THEN 'greeting' WHEN n IS NULL THEN 'no_contexts' WHEN best > 0.6 THEN 'low_relevance' ELSE 'success' END AS status,
  coalesce(n, 0)::BIGINT AS num_contexts, best::DOUBLE AS best_distance FROM q LEFT JOIN h USING (query_id)""")
def route_query(spark, sf_dir):
    """Greeting, nothing found, too far away, or success; distances of the stand-in are small, hence the gate at 0.6."""
    q, d = _texts(spark, sf_dir)
    hits = dense_hits(q, d, 5).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(2 - 2 * F.max("score"), 6).alias("best"))
    text = F.when(F.col("query_id") % 4 == 0, F.concat(F.lit("hi "), F.col("query_id").cast("string"))).otherwise(F.col("text"))
    status = F.when(X.is_greeting(F.col("text")), "greeting").when(F.col("n").isNull(), "no_contexts").when(F.col("best") > 0.6, "low_relevance").otherwise("success")
    return q.withColumn("text", text).join(hits, "query_id", "left").select("query_id", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("num_contexts"), F.col("best").alias("best_distance"))


@query(f"""WITH {_DENSE}, t AS (SELECT t.*, d.lang, d.source, d.text FROM {_top('dense', 5)} t JOIN documents d ON d.doc_id = t.id),
x AS (SELECT *, count(CASE WHEN lang = 'de' THEN 1 END) OVER (PARTITION BY query_id) AS n FROM t)
SELECT query_id, id, lang, rank::BIGINT AS rank FROM x WHERE lang = 'de' OR n = 0""")
def filter_with_fallback(spark, sf_dir):
    q, d = _texts(spark, sf_dir)
    rows = dense_hits(q, d, 5).join(d.select("id", "lang"), "id")
    return search.or_all(rows, F.col("lang") == "de", "query_id").select("query_id", "id", "lang", "rank")


@query(f"""WITH {_DENSE}, t AS (SELECT t.*, d.source, d.text FROM {_top('dense', 3)} t JOIN documents d ON d.doc_id = t.id)
SELECT query_id, id, text AS content, coalesce(CASE WHEN id % 2 = 0 THEN source END, 'Unknown') AS source, coalesce(score, 0)::DOUBLE AS relevance_score FROM t""")
def code_snippets(spark, sf_dir):
    q, d = _texts(spark, sf_dir)
    rows = search.fetched(dense_hits(q, d, 3), d.select("id", "text", "source"), "id", q.count() * 3)
    source = F.coalesce(F.when(F.col("id") % 2 == 0, F.col("source")), F.lit("Unknown"))
    return rows.select("query_id", "id", F.col("text").alias("content"), source.alias("source"), F.coalesce("score", F.lit(0.0)).alias("relevance_score"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS content, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def dedup_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", F.md5("text").alias("content"), "copies")


@query(f"""WITH {_TFIDF}, t AS (SELECT query_id, list(DISTINCT d.source) AS sources FROM {_top('sparse', 5)} JOIN documents d ON d.doc_id = id GROUP BY query_id)
SELECT query_id, (list_contains(sources, 'src' || (query_id % 20)) AND NOT list_contains(sources, 'src' || ((query_id + 1) % 20))) AS precise FROM t""")
def retrieval_precision_check(spark, sf_dir):
    """Whether an expected source is among the hits and a forbidden one is not."""
    q, d = _texts(spark, sf_dir)
    hits = tfidf.search(q, d, 5).join(d.select("id", "source"), "id")
    want, bar = (F.concat(F.lit("src"), ((F.col("query_id") + k) % 20).cast("string")) for k in (0, 1))
    return hits.groupBy("query_id").agg((F.bool_or(F.col("source") == want) & ~F.bool_or(F.col("source") == bar)).alias("precise"))


# --- context budgets: turns are the contexts of their conversation ---

_BUDGET = 120


def _prefix(rel: str, order: str, text: str = "text", cols: str = "conv_id, turn") -> str:
    return f"SELECT {cols}, used_tokens::BIGINT AS used_tokens FROM (SELECT *, sum(length({text}) // 4) OVER (PARTITION BY conv_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS used_tokens FROM {rel}) WHERE used_tokens <= {_BUDGET}"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query(_prefix("conversations", "turn"))
def compress_prefix(spark, sf_dir):
    return compress.prefix(_turns(spark, sf_dir), "conv_id", [F.asc("turn")], budget=_BUDGET).select("conv_id", "turn", "used_tokens")


_EXTRACT = f"""WITH q AS (SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
p AS (SELECT conv_id, turn, text, question, list_distinct({words('lower(question)')}) AS qw, list_distinct({words('lower(text)')}) AS tw FROM conversations JOIN q USING (conv_id) WHERE length(trim(text)) >= 10),
s AS (SELECT conv_id, turn, text, round({OVERLAP}, 6) AS score FROM p) """ + _prefix("s", "score DESC, turn")


def _scored(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    q = turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    return turns.join(q, "conv_id").withColumn("score", F.round(X.overlap_score(F.col("question"), F.col("text")), 6))


@query(_EXTRACT)
def compress_extractive(spark, sf_dir):
    return compress.extractive(_scored(spark, sf_dir), "conv_id", "score", "turn", budget=_BUDGET).select("conv_id", "turn", "used_tokens")


@query(_EXTRACT)
def compress_hybrid(spark, sf_dir):
    return compress.hybrid(_scored(spark, sf_dir), "conv_id", "score", "turn", budget=_BUDGET).select("conv_id", "turn", "used_tokens")


@query(f"WITH s AS (SELECT conv_id, turn, {_FIRST} AS summary FROM conversations WHERE length(trim(text)) >= 50) " + _prefix("s", "turn", "summary", "conv_id, turn, summary"))
def compress_abstractive(spark, sf_dir):
    rows = compress.abstractive(_turns(spark, sf_dir), "conv_id", [F.asc("turn")], first_sentence(F.col("text")), budget=_BUDGET)
    return rows.select("conv_id", "turn", "summary", "used_tokens")


@query("WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 5) " + _prefix("s", "turn"))
def compress_sliding(spark, sf_dir):
    return compress.sliding(_turns(spark, sf_dir), "conv_id", "turn", budget=_BUDGET).select("conv_id", "turn", "used_tokens")


def _back(n: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS back FROM conversations) WHERE back <= {n})"


@query(f"SELECT conv_id, turn, role, text, back FROM {_back(10)}")
def conversation_window(spark, sf_dir):
    return memory.last_turns(_turns(spark, sf_dir), 10).select("conv_id", "turn", "role", "text", "back")


@query(f"SELECT conv_id, turn, role, back FROM {_back(3)}")
def recent_context(spark, sf_dir):
    return memory.last_turns(_turns(spark, sf_dir), 3).select("conv_id", "turn", "role", "back")


@query(f"SELECT conv_id, turn, back FROM {_back(5)}")
def recent_history(spark, sf_dir):
    return memory.last_turns(_turns(spark, sf_dir), 5).select("conv_id", "turn", "back")


_LINE = "CASE WHEN role = 'assistant' THEN 'A: ' || substr(text, 1, 100) || '...' ELSE 'Q: ' || text END"
_SUMMARY = f"SELECT conv_id, array_to_string(list({_LINE} ORDER BY turn), chr(10)) AS summary FROM {_back(3)} GROUP BY conv_id"


@query(_SUMMARY)
def conversation_summary(spark, sf_dir):
    return memory.summary(_turns(spark, sf_dir))


@query(f"""WITH s AS ({_SUMMARY}) SELECT conv_id, turn, CASE WHEN summary IS NULL THEN text ELSE 'Previous conversation:' || chr(10) || summary || chr(10) || chr(10) || 'Current question: ' || text END AS augmented
FROM conversations LEFT JOIN s USING (conv_id) WHERE role = 'user'""")
def augment_question(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return memory.augment(turns.where("role = 'user'"), memory.summary(turns)).select("conv_id", "turn", "augmented")



