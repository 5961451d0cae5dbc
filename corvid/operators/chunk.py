"""Splitters: one row of text to many chunks."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.text import looks_like_code, strip


def _check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap < 0 or overlap >= size:
        raise ValueError("overlap must be at least 0 and less than the chunk size")


def fixed(docs: DataFrame, text: str = "text", size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; ``end_index`` is not clipped to the text.

    Columns chunk_ord, content, start_index, end_index are added; empty texts have no chunk.
    """
    _check(size, overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    rows = docs.select("*", F.posexplode(starts).alias("chunk_ord", "start_index"))
    return rows.withColumn("content", F.substring(F.col(text), F.col("start_index") + 1, F.lit(size))).withColumn("end_index", F.col("start_index") + size).drop(text)


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Sentences parted by white space after ``.``, ``!`` or ``?``; blanks are dropped after numbering."""
    rows = docs.select("*", F.posexplode(F.split(text, r"(?U)(?<=[.!?])\s+")).alias("sentence_index", "_raw"))
    return rows.withColumn("content", strip(F.col("_raw"))).where("content != ''").drop(text, "_raw")


def with_metadata(chunks: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Chunks of ``fixed`` whose map of metadata has their own place: chunk_id, start_index and end_index replace values of these keys.

    A null map counts as an empty one.
    """
    own = {"chunk_id": "chunk_ord", "start_index": "start_index", "end_index": "end_index"}
    place = F.create_map(*[x for key, c in own.items() for x in (F.lit(key), F.col(c).cast("string"))])
    kept = F.map_filter(F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*own))
    return chunks.withColumn(metadata, F.map_concat(kept, place))


def is_python(text: str) -> bool:
    try:
        ast.parse(text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def code_lines(lines: list[str], size: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open line ranges of chunks of Python code.

    Lines gather until they exceed ``size`` characters, newlines counted; the
    line that exceeds it still belongs to the chunk. An ``async def`` line starts
    a new chunk early once 0.7 of the size is reached, and the last
    ``overlap // 50`` lines are then repeated.
    """
    out, first, held = [], 0, 0
    for i, line in enumerate(lines):
        if held > size * 0.7 and i > first and line.strip().startswith("async def "):
            out.append((first, i))
            first = max(first, i - overlap // 50)
            held = sum(len(x) + 1 for x in lines[first:i])
        held += len(line) + 1
        if held > size:
            out.append((first, i + 1))
            first, held = i + 1, 0
    if first < len(lines):
        out.append((first, len(lines)))
    return out


def code_windows(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of ``size`` characters that end after the last newline inside, each ``overlap`` before the last end.

    A window that ends the text early still reports its full width; each one starts at least
    a character after the one before, so the split always ends.
    """
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            newline = text.rfind("\n", start, end)
            if newline > start:
                end = newline + 1
        out.append((start, end))
        start = max(end - overlap, start + 1)
    return out


_CHUNKS = T.ArrayType(T.StructType([T.StructField("chunk_ord", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("start_index", T.IntegerType()), T.StructField("end_index", T.IntegerType())]))


def code(docs: DataFrame, text: str = "text", size: int = C.CODE_CHUNK_SIZE, overlap: int = C.CODE_CHUNK_OVERLAP, kind: str = "auto") -> DataFrame:
    """Chunks of code with column ``type``: ``python_code`` by lines or ``code`` by windows; indices are lines or characters.

    ``kind`` forces one of them; ``auto`` asks the parser, then the fixed patterns.
    """
    _check(size, overlap)

    def split(x, python):
        out = []
        for t, p in zip(x, python, strict=True):
            if not t:
                out.append([])
            elif p:
                lines = t.split("\n")
                out.append([(k, "\n".join(lines[a:b]), a, b) for k, (a, b) in enumerate(code_lines(lines, size, overlap))])
            else:
                out.append([(k, t[a:b], a, b) for k, (a, b) in enumerate(code_windows(t, size, overlap))])
        return out

    @F.pandas_udf(_CHUNKS)
    def chunks(x: pd.Series, python: pd.Series) -> pd.Series:
        return pd.Series(split(x, python))

    @F.pandas_udf("boolean")
    def parses(x: pd.Series) -> pd.Series:
        return x.map(lambda t: is_python(t or ""))

    if kind == "auto":
        python = F.coalesce(looks_like_code(F.col(text)), F.lit(False)) | parses(text)
    else:
        python = F.lit(kind == "python_code")
    rows = docs.withColumn("_python", python)
    rows = rows.withColumn("type", F.when(F.col("_python"), "python_code").otherwise("code"))
    return rows.select("*", F.inline(chunks(F.col(text), F.col("_python")))).drop(text, "_python")
