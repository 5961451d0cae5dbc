"""Shards of a corpus, each with the corpus's mixture of sources.

Rows of a source are shuffled by a seeded digest and ranked. A row's fractional
rank is (rank + start) / rows of its source, where ``start``, between 0 and 1, is a
seeded fraction of the source, so that small sources don't all meet in the
middle. All rows are sorted by fractional rank and cut into equal runs. A run is an
interval of fractions, of which each source fills its share, so each shard holds
each source in proportion (a row or so more or less), and shards differ by one row at
most. Rows of a shard, by slot, are interleaved in the same way.

No sort is global and no window spans a source. Ranks come from counts: rows fall
into buckets by their digest, which is uniform, buckets are counted and summed up,
and rows are ranked inside their bucket. The order of fractions is made likewise,
from buckets of fractions. The text is read once, to be measured; rows of some 60
bytes move. Sums over buckets have max(1024, rows / 100,000) rows for a source.

Null and empty texts have size 1 and CRC-32 0. A null source counts as the source
''. Null doc_ids are ranked as any other. Repeated rows (same doc_id, source and
text) are counted as one row with a number before they move, so a row that is
repeated without limit meets in no task; each gets a place of its own. Ties of the
digest are broken by doc_id, size and CRC-32. Long texts are measured whole. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize, release

#: Equal rows are put out in pieces of so many.
PIECE = 4096
_KEY = ("doc_id", "source", "size", "text_crc32", "text_md5")


def _fraction(text: Column) -> Column:
    """A number from 0 to 2**52, from the MD5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _measured(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.md5(raw).alias("text_md5"),
    )


def _starts(rows: DataFrame, bucket: str, by: list[str], number: Column) -> DataFrame:
    """by, bucket, before (rows of earlier buckets) and total of each bucket."""
    sums = rows.groupBy(*by, bucket).agg(F.sum(number).alias("_n"))
    whole = Window.partitionBy(*by)
    running = F.sum("_n").over(whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0))
    return sums.select(*by, bucket, (running - F.col("_n")).alias("before"), F.sum("_n").over(whole).alias("total"))


def assign(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes + 1), text_crc32, text_md5, shard (0 to ``shards`` - 1) and slot (from 0, gapless) of each row of ``docs (doc_id, source, text)``."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    shuffled = _fraction(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32"))
    kinds = materialize(_measured(docs).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", shuffled), "kinds")
    rows, most = kinds.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    buckets = max(1024, rows // 100_000)

    bucketed = kinds.withColumn("bucket", F.floor(F.col("digest") * F.lit(buckets / 2.0**52)).cast("long"))
    inside = Window.partitionBy("source", "bucket").orderBy("digest", F.asc_nulls_first("doc_id"), "size", "text_crc32", "text_md5").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bucketed.join(_starts(bucketed, "bucket", ["source"], F.col("copies")), ["source", "bucket"]).withColumn("first", F.col("before") + F.sum("copies").over(inside) - F.col("copies"))
    if most > PIECE:
        ranked = ranked.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PIECE))))
        ranked = ranked.withColumns({"first": F.col("first") + F.col("piece") * PIECE, "copies": F.least(F.lit(PIECE), F.col("copies") - F.col("piece") * PIECE)}).repartition("source", "first")
    ranked = ranked.withColumn("rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))

    start = _fraction(F.concat_ws(":", F.lit(str(seed)), "source")) / F.lit(2.0**52)
    fraction = (F.col("rank") + start) / F.col("total")
    placed = materialize(ranked.select(*_KEY, "rank", fraction.alias("fraction"), F.least(F.lit(buckets - 1), F.floor(fraction * F.lit(float(buckets)))).cast("long").alias("bucket")), "placed")
    release(kinds)

    inside = Window.partitionBy("bucket").orderBy("fraction", "source", "rank")
    place = F.col("before") + F.row_number().over(inside) - 1
    out = placed.join(_starts(placed.withColumn("all", F.lit(0)), "bucket", ["all"], F.lit(1)), "bucket").withColumn("place", place)
    shard = F.expr(f"(place * {shards}) div {max(rows, 1)}")
    first = F.expr(f"(((place * {shards}) div {max(rows, 1)}) * {rows} + {shards - 1}) div {shards}")
    return out.select(*_KEY, shard.cast("int").alias("shard"), (F.col("place") - first).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 8, seed: int = 17) -> None:
    """Write all columns of ``docs`` to ``path/shard=k``, each shard's rows by slot.

    Each row moves twice: to its place in the assignment, then to its shard. A
    shard is one sorted task's output, cut into files of 1,000,000 rows.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keys = {"_doc": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_md5": F.md5(raw)}
    places = assign(docs, shards, seed).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), F.col("source").alias("_source"), F.col("text_md5").alias("_md5"), F.col("shard").alias("shard"), F.col("slot").alias("_slot"))
    whole = docs.withColumns(keys).dropDuplicates(list(keys))
    out = whole.drop("shard").join(places, list(keys)).repartition(shards, "shard").sortWithinPartitions("shard", "_slot")
    out.drop(*keys, "_slot").write.option("maxRecordsPerFile", 1_000_000).partitionBy("shard").parquet(path)


#: DuckDB: CRC-32 of a text's bytes, by its table of 256 entries made from the polynomial.
CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def crc32_sql(text: str, table: str = "t") -> str:
    """DuckDB SQL of the CRC-32 of ``text``, where ``table`` is a list made by ``CRC_TABLE``."""
    digits = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


def oracle(shards: int = 8, seed: int = 17) -> str:
    fraction = "('0x' || substr(md5({}), 1, 13))::BIGINT"
    return f"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
m AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
h AS (SELECT *, {fraction.format(f"concat_ws(':', '{seed}', coalesce(doc_id::VARCHAR, ''), size, text_crc32)")} AS digest FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY digest, doc_id NULLS FIRST, size, text_crc32) - 1 AS rank, count(*) OVER (PARTITION BY source) AS total FROM h),
f AS (SELECT *, (rank + {fraction.format(f"'{seed}:' || source")} / 4503599627370496.0::DOUBLE) / total AS fraction FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source, rank) - 1 AS place, count(*) OVER () AS n FROM f)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * {shards} // n)::INTEGER AS shard,
  (place - ((place * {shards} // n) * n + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""
