"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_substring_dedup(spark, sf_dir):
    from .substring_dedup import substring_dedup

    return substring_dedup(_docs(spark, sf_dir), window=13)


def op2_decontamination(spark, sf_dir):
    from .decontamination import decontaminate

    return decontaminate(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark, sf_dir):
    from .quality_rules import quality

    return quality(_docs(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_lm_scoring(spark, sf_dir):
    from .lm_scoring import lm_score

    return lm_score(_docs(spark, sf_dir))


def op5_toxicity(spark, sf_dir):
    from .toxicity import fit, score

    docs = _docs(spark, sf_dir)
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op6_ngram_jaccard(spark, sf_dir):
    from .ngram_jaccard import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), n=4, percent=85)


def op7_language_id(spark, sf_dir):
    from .language_id import identify, learn

    docs = _docs(spark, sf_dir)
    # rows without a doc_id are not learnt from
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))
    out = identify(docs, learn(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_html_extraction(spark, sf_dir):
    from .html_extraction import extract, fit

    pages = _table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


def op9_license_scan(spark, sf_dir):
    from .license_scan import scan

    return scan(_docs(spark, sf_dir))


def op10_byte_bpe(spark, sf_dir):
    from .byte_bpe import encode_digests

    return encode_digests(_docs(spark, sf_dir), tokenizer_path())


def op11_stratified_sharding(spark, sf_dir):
    from .sharding import assign

    out = assign(_docs(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_filter_audit(spark, sf_dir):
    from .filter_audit import audit

    return audit(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark, sf_dir):
    from .conversation_repair import damage, repair_digests

    turns = _table(spark, sf_dir, "conversations")
    return repair_digests(damage(turns), turns)


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_quality_rules": op3_quality_rules,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_toxicity": op5_toxicity,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_language_id": op7_language_id,
        "op8_html_extraction": op8_html_extraction,
        "op9_license_scan": op9_license_scan,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_stratified_sharding": op11_stratified_sharding,
        "op12_filter_audit": op12_filter_audit,
        "op13_conversation_repair": op13_conversation_repair,
    }


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (
  SELECT doc_id, u.i AS i, array_to_string(words[u.i:u.i + 12], ' ') AS g
  FROM w, unnest(range(1, greatest(len(words) - 11, 1))) AS u(i)),
lo AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT win.doc_id, win.i + o.k AS i
  FROM win JOIN lo USING (g), unnest(range(13)) AS o(k) WHERE win.doc_id > lo.lo),
g AS (SELECT doc_id, list(i) AS spots FROM gone GROUP BY doc_id),
k AS (
  SELECT w.doc_id, words, coalesce(spots, []) AS spots,
    list_filter(words, lambda x, i: NOT list_contains(coalesce(spots, []), i)) AS kept
  FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(words)::BIGINT AS n_words, len(spots)::BIGINT AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

OP3 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, u.i AS i, array_to_string(words[u.i:u.i + 2], ' ') AS g
  FROM w, unnest(range(1, greatest(len(words) - 1, 1))) AS u(i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
rep AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n
  FROM twice, unnest([0, 1, 2]) AS o(k) WHERE n > 1 GROUP BY doc_id),
stop AS (SELECT unnest(string_split('@STOP@', ' ')) AS word),
stops AS (
  SELECT doc_id, count(*)::BIGINT AS n
  FROM (SELECT doc_id, lower(unnest(words)) AS word FROM w) SEMI JOIN stop USING (word) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, coalesce(stops.n, 0) AS n_stop,
    length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper,
    len(list_filter(lines, lambda x: contains(x, ' | '))) AS n_bar
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN stops USING (doc_id)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / n_words <= 0.1
   AND n_stop / n_words >= 0.06 AND n_upper / word_chars <= 0.5 AND n_dup_lines / n_lines <= 0.5
   AND n_bar / n_lines <= 0.5 AND n_repeat_words / n_words <= 0.5) AS kept
FROM f
"""


def oracle_sql() -> dict[str, str]:
    from .conversation_repair import oracle as op13
    from .filter_audit import ORACLE as OP12
    from .license_scan import ORACLE as OP9
    from .quality_rules import STOP_WORDS
    from .sharding import oracle as op11

    return {"op1_substring_dedup": OP1, "op3_quality_rules": OP3.replace("@STOP@", " ".join(STOP_WORDS)), "op9_license_scan": OP9, "op11_stratified_sharding": op11(), "op12_filter_audit": OP12, "op13_conversation_repair": op13()}
