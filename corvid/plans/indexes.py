"""Queries on what outlives a query: the vector index, the text index and the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import chunk
from ..operators.embedcache import EmbeddingCache
from ..operators.hooks import hashed_embedding
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..sources.store import Store
from .common import TOKEN, query, table
from .retrieval import _TFIDF, _ranked, _texts, _top, _vectors
from .tables import _place


@query()
def ivf_topk(spark, sf_dir):
    """The inverted file, built and searched."""
    q, c = _vectors(spark, sf_dir)
    return VectorIndex(spark, _place(spark)).build(c.select("id", "vector")).search(q)


@query("""SELECT count(*) FILTER (vec_id % 100 = 0)::BIGINT AS questions, count(*)::BIGINT AS vectors, (count(*) FILTER (vec_id % 100 = 0) * least(5, count(*)))::BIGINT AS exact_hits,
true AS recall_reached, true AS vectors_spared FROM embeddings""")
def ivf_report(spark, sf_dir):
    """Whether the index finds nine of ten rows of exact search, and reads less than a twentieth of the vectors for a question."""
    q, c = _vectors(spark, sf_dir)
    index = VectorIndex(spark, _place(spark)).build(c.select("id", "vector"))
    found = index.measured(q, c.select("id", "vector"))
    row = (q.count(), index.rows().count(), found["exact_hits"], found["recall"] >= 0.9, found["vectors"] < 0.05)
    return spark.createDataFrame([row], "questions long, vectors long, exact_hits long, recall_reached boolean, vectors_spared boolean")


@query(f"WITH {_TFIDF} SELECT query_id, id, score, rank::BIGINT AS rank FROM {_top('sparse', 5)}")
def text_index_search(spark, sf_dir):
    """The index filled in two parts gives what a search of the corpus gives."""
    q, d = _texts(spark, sf_dir)
    index = TextIndex(spark, _place(spark))
    for part in (0, 1):
        index.add(d.where(F.col("id") % 2 == part).select("id", "text"))
    return index.search(q)


_LIVE = "live AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'changed ' || text ELSE text END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"


@query(f"WITH {_LIVE}, {_TFIDF.replace('documents', 'live')} SELECT query_id, id, score, rank::BIGINT AS rank FROM {_top('sparse', 5)}")
def text_index_changes(spark, sf_dir):
    """Documents replaced and deleted: weights follow the corpus as it is."""
    q, d = _texts(spark, sf_dir)
    index = TextIndex(spark, _place(spark))
    index.add(d.select("id", "text"))
    index.add(d.where("id % 10 = 1").select("id", F.concat(F.lit("changed "), "text").alias("text")))
    index.delete(table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))
    return index.search(q)


@query("""SELECT 1::BIGINT AS version, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT 2, count(*), sum(length(text))::BIGINT FROM documents
UNION ALL SELECT 3, count(*), sum(length(text))::BIGINT FROM documents WHERE doc_id % 5 <> 2
UNION ALL SELECT 4, count(*), sum(CASE WHEN doc_id % 3 = 0 THEN 7 ELSE length(text) END)::BIGINT FROM documents WHERE doc_id % 5 <> 2
UNION ALL SELECT 5, count(*), sum(CASE WHEN doc_id % 3 = 0 THEN 7 ELSE length(text) END)::BIGINT FROM documents WHERE doc_id % 5 <> 2""")
def store_versions(spark, sf_dir):
    """Appended twice, deleted from, updated, compacted; each version as it was."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = Store(spark, _place(spark))
    for part in (0, 1):
        held.add(docs.where(F.col("doc_id") % 2 == part))
    held.delete(docs.where("doc_id % 5 = 2").select("doc_id"), "doc_id")
    held.update(docs.where("doc_id % 3 = 0").select("doc_id", F.lit("changed").alias("text")), "doc_id")
    held.compact()
    out = None
    for version in range(1, held.version() + 1):
        rows = held.read(version).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars")).select(F.lit(version).cast("long").alias("version"), "n", "chars")
        out = rows if out is None else out.union(rows)
    return out


_FILTER = {"$or": [{"label": {"$lt": 3}}, {"$and": [{"parity": "odd"}, {"label": {"$in": [7, 8]}}]}], "tenth": {"$exists": False}, "$not": {"label": {"$gt": 7}}}
_FILTER_SQL = "(label < 3 OR (id % 2 = 1 AND label IN (7, 8))) AND id % 10 <> 0 AND label <= 7"


def _filled(spark, sf_dir):
    _, c = _vectors(spark, sf_dir)
    tenth = F.when(F.col("id") % 10 == 0, F.create_map(F.lit("tenth"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>"))
    meta = F.map_concat(F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("parity"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd")), tenth)
    held = Store(spark, _place(spark), {"label": "long", "parity": "string"})
    held.add(c.select("id", "vector", meta.alias("metadata")))
    return held


_META = ", label::BIGINT AS label, CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity"


def _searched(spark, sf_dir, before):
    q, _ = _vectors(spark, sf_dir)
    hits = _filled(spark, sf_dir).search(q, 5, _FILTER, before)
    return hits.select("query_id", "id", "score", "rank", F.col("metadata")["label"].cast("long").alias("label"), F.col("metadata")["parity"].alias("parity"))


@query(_ranked("l2", "l2", _FILTER_SQL, _META))
def store_search_filtered(spark, sf_dir):
    """A nested filter on metadata before the best are taken."""
    return _searched(spark, sf_dir, True)


@query(_ranked("l2", "l2", extra=_META) + f" AND {_FILTER_SQL}")
def store_search_postfiltered(spark, sf_dir):
    """The same filter after the best are taken."""
    return _searched(spark, sf_dir, False)


@query("""SELECT doc_id, i::BIGINT AS chunk_id, source, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, 'Unknown') AS lang, (i * 450)::BIGINT AS start_index, (i * 450 + 500)::BIGINT AS end_index
FROM documents, unnest(range((length(text) + 449) // 450)) AS u(i)""")
def chunk_metadata(spark, sf_dir):
    """Each chunk carries its document's metadata, with its own place put in."""
    docs = table(spark, sf_dir, "documents")
    lang = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("lang"), F.col("lang"))).otherwise(F.create_map().cast("map<string,string>"))
    meta = F.map_concat(F.create_map(F.lit("source"), F.col("source"), F.lit("chunk_id"), F.lit("none")), lang)
    rows = chunk.with_metadata(chunk.fixed(docs.select("doc_id", "text", meta.alias("metadata")), size=C.CHUNK_SIZE, overlap=C.CHUNK_OVERLAP))
    got = lambda key, default=None: F.coalesce(F.col("metadata")[key], F.lit(default))
    return rows.select("doc_id", got("chunk_id").cast("long").alias("chunk_id"), got("source").alias("source"), got("lang", "Unknown").alias("lang"), got("start_index").cast("long").alias("start_index"), got("end_index").cast("long").alias("end_index"))


@query(f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}+')) AS tok FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS place, count(*) AS c FROM t GROUP BY ALL)
SELECT d.doc_id, coalesce(sum(b.c), 0)::DOUBLE AS tokens, coalesce(round(sqrt(sum(b.c * b.c)), 6), 0)::DOUBLE AS length,
  (SELECT count(DISTINCT text) FROM documents WHERE doc_id % 2 = 0)::BIGINT AS first_made,
  (SELECT count(DISTINCT text) FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0))::BIGINT AS second_made, 0::BIGINT AS third_made
FROM documents d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id
""")
def embed_cached(spark, sf_dir):
    """Vectors kept by content: the second job embeds only what the first one had not seen, the third one nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = EmbeddingCache(spark, _place(spark), "hashed")
    _, one = cache.embed(docs.where("doc_id % 2 = 0"), hashed_embedding)
    _, two = cache.embed(docs, hashed_embedding)
    rows, three = cache.embed(docs, hashed_embedding)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    length = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 6)
    made = {"first_made": one, "second_made": two, "third_made": three}
    return rows.select("doc_id", total.alias("tokens"), length.alias("length"), *[F.lit(n).cast("long").alias(c) for c, n in made.items()])
