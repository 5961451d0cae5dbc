"""Readers of documents."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, extension, loader_of, strip
from . import office


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole UTF-8 files; Markdown is read as it is."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def binaries(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """path, file_type, content, modified of files that some loader reads; others are left out."""
    known = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(known).load(path) if stream else spark.read.format("binaryFile").load(path)
    return rows.select("path", loader_of(extension(F.col("path"))).alias("file_type"), "content", F.col("modificationTime").alias("modified")).where("file_type is not null")


def _pdf(content: bytes) -> str:
    import io

    from pypdf import PdfReader

    pages = [(i, (p.extract_text() or "").strip()) for i, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]
    return "\n\n".join(f"Page {i}:\n{t}" for i, t in pages if t)


_LOADERS = {"text": lambda b: b.decode("utf-8"), "markdown": lambda b: b.decode("utf-8"), "pdf": _pdf, "docx": office.docx, "excel": office.excel}


def documents(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """path, file_type, text, error of files by their extension.

    Files that fail have a null text and an error, so that no error message is
    ever indexed. PDF needs its optional library; old binary Word and Excel files are
    errors. As a ``stream``, files that come to the folder are read once.
    """

    def load(batches):
        for batch in batches:
            out = []
            for kind, content in zip(batch["file_type"], batch["content"], strict=True):
                try:
                    out.append((_LOADERS[kind](bytes(content)), None))
                except Exception as e:  # noqa: BLE001  any library's error is the row's
                    out.append((None, f"{type(e).__name__}: {e}"))
            batch["text"], batch["error"] = [o[0] for o in out], [o[1] for o in out]
            yield batch[["path", "file_type", "text", "error"]]

    return binaries(spark, path, stream).select("path", "file_type", "content").mapInPandas(load, "path string, file_type string, text string, error string")


def row_text(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """``column: value`` of the cells that are not null, joined by `` | ``."""
    cells = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns or rows.columns]
    return F.concat_ws(" | ", *cells)


def sheet(rows: DataFrame, name: str, key: str) -> DataFrame:
    """sheet, row, line: a header line (row -1) and a line for each row with a cell."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(name, -1, f"=== Sheet: {name} ===")], "sheet string, row long, line string")
    return head.union(rows.select(F.lit(name), F.col(key).cast("long"), row_text(rows).alias("line")).where("line != ''"))


def registry(files: DataFrame) -> DataFrame:
    """id, name, file_path of uploads called ``<36 characters>_<name>``; other files are left out."""
    name = base_name(F.col("path"))
    ident = F.element_at(F.split(name, "_", 2), 1)
    return files.select("*", ident.alias("id"), F.substring(name, 38, 1 << 30).alias("name")).where(F.length("id") == 36)


def eval_examples(spark: SparkSession, path: str) -> DataFrame:
    """question, ground_truth of a JSON list of examples."""
    return spark.read.schema("question string, ground_truth string").json(path, multiLine=True)


def squad_examples(rows: DataFrame, most: int | None = None) -> DataFrame:
    """question, ground_truth (the first answer, null without one), context."""
    out = rows.select("question", F.try_element_at("answers", F.lit(1)).alias("ground_truth"), "context")
    return out.limit(most) if most else out


DEFAULTS = {
    "text_splitter": {"type": "fixed_size", "chunk_size": 500, "chunk_overlap": 50},
    "retrieval": {"k": 5},
    "hybrid_search": {"alpha": 0.5, "keyword_boost": 2.0},
    "memory": {"max_turns": 10},
    "compression": {"max_tokens": 1000},
}


def settings(text: str) -> dict:
    """Settings from YAML."""
    import yaml

    return yaml.safe_load(text) or {}


def config(path: str | None = None, needed: bool = False) -> dict:
    """Settings from a YAML file over the defaults; an unreadable file gives the defaults, a missing one ``FileNotFoundError`` if it is ``needed``."""
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    try:
        found = settings(Path(path).read_text()) if path else {}
    except FileNotFoundError:
        if needed:
            raise
        found = {}
    except (OSError, ImportError, ValueError):
        found = {}
    for key, value in found.items():
        out[key] = {**out.get(key, {}), **value} if isinstance(value, dict) else value
    return out


def is_blank(x: Column) -> Column:
    return strip(x) == ""
