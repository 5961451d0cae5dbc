"""Queries on sources, sinks and the store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunk
from ..operators.hooks import embed_distinct as _embed_distinct
from ..operators.hooks import hashed_embedding
from ..sources import files, store
from .common import TOKEN, query, table


def _place(spark) -> str:
    """A new folder that driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/corvid-{uuid.uuid4().hex}"


_LINES = "SELECT line, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), chr(13))) AS line FROM benchmark) GROUP BY line"


def _reread(spark, sf_dir):
    path = _place(spark)
    table(spark, sf_dir, "benchmark").select(F.replace("text", F.lit("\n"), F.lit(" "))).write.text(path)
    lines = F.explode(F.split(F.rtrim(F.col("text")), "\n"))
    return files.texts(spark, path).select(lines.alias("line")).where("line != ''").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(_LINES)
def scan_text(spark, sf_dir):
    """Write the items as text files, read the files whole, and count their lines."""
    return _reread(spark, sf_dir)


@query(_LINES)
def scan_markdown(spark, sf_dir):
    """Markdown is text."""
    return _reread(spark, sf_dir)


def _sheet_sql(name: str, key: str, columns: tuple[str, ...]) -> str:
    cells = ", ".join(f"'{c}: ' || {c}::VARCHAR" for c in columns)
    return f"SELECT '{name}' AS sheet, -1::BIGINT AS row, '=== Sheet: {name} ===' AS line UNION ALL SELECT '{name}', {key}::BIGINT, concat_ws(' | ', {cells}) FROM {name}"


@query(f"{_sheet_sql('nation', 'n_nationkey', ('n_nationkey', 'n_name'))} UNION ALL {_sheet_sql('region', 'r_regionkey', ('r_regionkey', 'r_name'))}")
def row_to_text(spark, sf_dir):
    n = files.sheet(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "nation", "n_nationkey")
    r = files.sheet(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "region", "r_regionkey")
    return n.union(r).toDF("sheet", "row", "line")


_PATH = "regexp_replace(url, '[?#].*$', '')"


@query(f"""SELECT page_id, regexp_extract(lower(p), '(\\.[^./]+)$', 1) AS extension,
CASE regexp_extract(lower(p), '(\\.[^./]+)$', 1) WHEN '.txt' THEN 'text' WHEN '.md' THEN 'markdown' WHEN '.pdf' THEN 'pdf' WHEN '.xls' THEN 'excel' WHEN '.xlsx' THEN 'excel' WHEN '.doc' THEN 'docx' WHEN '.docx' THEN 'docx' END AS loader
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN {_PATH} WHEN 1 THEN {_PATH} || '.PDF' ELSE {_PATH} || '.md' END AS p FROM pages)""")
def file_type_dispatch(spark, sf_dir):
    bare = F.regexp_replace("url", "[?#].*$", "")
    path = F.when(F.col("page_id") % 3 == 0, bare).when(F.col("page_id") % 3 == 1, F.concat(bare, F.lit(".PDF"))).otherwise(F.concat(bare, F.lit(".md")))
    rows = table(spark, sf_dir, "pages").select("page_id", X.extension(path).alias("extension"))
    return rows.withColumn("loader", X.loader_of(F.col("extension")))


@query("SELECT item_id, 'Is it true? ' || text AS question, CASE WHEN item_id % 5 <> 0 THEN text END AS ground_truth FROM benchmark")
def load_eval_examples(spark, sf_dir):
    """Write examples as JSON in the form of a public data set and load them."""
    path = _place(spark)
    answers = F.when(F.col("item_id") % 5 != 0, F.array("text")).otherwise(F.array().cast("array<string>"))
    table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("Is it true? "), "text").alias("question"), answers.alias("answers"), F.lit("").alias("context")).write.json(path)
    rows = spark.read.schema("item_id long, question string, answers array<string>, context string").json(path)
    return rows.select("item_id", "question", F.try_element_at("answers", F.lit(1)).alias("ground_truth"))


_UUID = "substr(md5(doc_id::VARCHAR), 1, 8) || '-' || substr(md5(doc_id::VARCHAR), 9, 4) || '-' || substr(md5(doc_id::VARCHAR), 13, 4) || '-' || substr(md5(doc_id::VARCHAR), 17, 4) || '-' || substr(md5(doc_id::VARCHAR), 21, 12)"


@query(f"SELECT doc_id, {_UUID} AS id, source || '_' || doc_id || '.txt' AS name FROM documents WHERE doc_id % 7 <> 0")
def document_registry(spark, sf_dir):
    h = F.md5(F.col("doc_id").cast("string"))
    ident = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat(F.lit("/uploads/"), F.when(F.col("doc_id") % 7 == 0, F.lit("stray")).otherwise(ident), F.lit("_"), name)
    return files.registry(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))).select("doc_id", "id", "name")


@query("SELECT (SELECT count(*) FROM documents)::BIGINT AS n, doc_id, substr(text, 1, 100) AS content FROM documents ORDER BY doc_id LIMIT 5")
def store_peek(spark, sf_dir):
    held = store.Store(spark, _place(spark))
    held.add(table(spark, sf_dir, "documents"))
    n, rows = held.peek(5, "doc_id")
    return rows.select(F.lit(n).cast("long").alias("n"), "doc_id", F.substring("text", 1, 100).alias("content"))


@query("SELECT vec_id, label::BIGINT AS label, len(embedding)::BIGINT AS dim, 2::BIGINT AS times FROM embeddings")
def store_append(spark, sf_dir):
    """Append the vectors twice."""
    path = _place(spark)
    rows = table(spark, sf_dir, "embeddings")
    for _ in range(2):
        store.appended(path, rows.select("vec_id", "label"), rows.select("vec_id", "embedding"), "vec_id")
    out = spark.read.parquet(path).groupBy("vec_id", "label", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("times"))
    return out.select("vec_id", F.col("label").cast("long").alias("label"), F.col("dim").cast("long").alias("dim"), "times")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'changed ' || doc_id ELSE text END AS text, lang, source FROM documents")
def upsert_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    changes = docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("changed "), F.col("doc_id").cast("string")).alias("text"), F.lit(None).cast("string").alias("lang"))
    held = store.Store(spark, _place(spark))
    held.add(docs)
    held.update(changes, "doc_id")
    return held.read()


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_documents(spark, sf_dir):
    held = store.Store(spark, _place(spark))
    held.add(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"))
    held.delete(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return held.read()


@query("SELECT event_id, event_type, round(value, 4)::DOUBLE AS value FROM events")
def export_json(spark, sf_dir):
    path = _place(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.round("value", 4).alias("value"))
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT event_id, event_type, round(value, 4)::DOUBLE AS value FROM events")
def export_csv(spark, sf_dir):
    path = _place(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.round("value", 4).alias("value"))
    rows.write.option("header", True).csv(path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("""SELECT e.vec_id, d.source, i::BIGINT AS chunk_ord, substr(d.text, i * 450 + 1, 500) AS content, len(e.embedding)::BIGINT AS dim
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, unnest(range((length(text) + 449) // 450)) AS u(i)""")
def attach_embeddings(spark, sf_dir):
    """Every chunk of a document with the document's vector."""
    chunks = chunk.fixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.join(chunks, F.col("vec_id") == F.col("doc_id")).select("vec_id", "source", F.col("chunk_ord").cast("long").alias("chunk_ord"), "content", F.size("embedding").cast("long").alias("dim"))


@query(f"""
WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '{TOKEN}+')) AS tok FROM conversations),
b AS (SELECT conv_id, turn, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS place, count(*) AS c FROM t GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(sum(b.c), 0)::DOUBLE AS tokens, coalesce(round(sqrt(sum(b.c * b.c)), 6), 0)::DOUBLE AS length
FROM conversations c LEFT JOIN b USING (conv_id, turn) GROUP BY ALL
""")
def embed_distinct(spark, sf_dir):
    rows = _embed_distinct(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", hashed_embedding)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return rows.select("conv_id", "turn", total.alias("tokens"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("length"))
