"""A corpus pipeline: each stage reads what its predecessor wrote.

1. language: documents without a language that the filters know go;
2. near_duplicates: of each group of near duplicates the least doc_id stays;
3. repeats: words of passages (13 words or more) that a smaller doc_id has go;
4. benchmark: documents that hold a benchmark item, or an edited copy, go;
5. tokens: the remaining texts encoded by byte-level BPE.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvid._ship import ship
from corvid.llm import byte_bpe, decontamination, language_id, ngram_jaccard, substring_dedup
from corvid.llm._store import shared_dir
from corvid.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all rows that carry a language; keep those whose text is in one of them."""
    ship(spark)
    return language_id.keep_identified(docs, language_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component (4-word shingles, similarity 0.85)."""
    ship(spark)
    return ngram_jaccard.drop_near_duplicates(docs, n=4, percent=85)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand in a document of smaller doc_id."""
    ship(spark)
    return substring_dedup.drop_repeats(docs, window=13)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    ship(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts."""
    ship(spark)
    return byte_bpe.encode_digests(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("tokens", tokens)]

#: Language filters, alignments and BPE have no SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/corvid-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
