"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are maximal runs of letters, digits and non-ASCII characters, A-Z
lower-cased. Each item's seeds are all of its word trigrams. Where a document
holds a seed of an item, the stretch of the document around it is aligned with
the item's words: 2 for a match, -1 for a mismatch or a gap. The score is the
best local alignment over the item's perfect score, so 1 is a verbatim copy.
Pairs of at least ``least`` count as contaminated.

No seed is dropped, however common it is in the corpus or in the group of a
document's copies. What common seeds cost is saved by a bound instead: an
alignment can't match more words than item and stretch share, so stretches that
share too few for ``least`` aren't aligned, and no pair is lost by that. Equal
stretches are aligned once in a task. The benchmark is the stated query set: it
is read in blocks of bounded size (``block_bytes`` of text), each of which is
broadcast and run against all rows. Nothing of the corpus is shuffled.

Null or empty texts match nothing. Items that are null or shorter than three
words are ignored. Repeated items each get their pairs. Repeated rows of
documents each give their pairs. Ties between places of a document go to the
first. Extra columns are ignored (and kept by ``drop_contaminated``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

SEED = 3
MATCH, MISS, GAP = 2, -1, -1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32


def words(data: np.ndarray) -> np.ndarray:
    folded = _FOLD[data]
    return T.word_hashes(folded, *T.word_bounds(folded))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and the half-open range of ``text`` that it covers."""
    n = len(text)
    steps = np.arange(n + 1) * GAP
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, span = 0, (0, 0)
    for w in item:
        diagonal = np.where(text == w, MATCH, MISS) + row[:-1]
        score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        up = row[1:] + GAP
        score[1:] = np.maximum(0, np.maximum(diagonal, up))
        start[1:] = np.where(score[1:] == 0, start[1:], np.where(diagonal >= up, begin[:-1], begin[1:]))
        # gaps along the text: the best predecessor less its distance, by a running maximum
        level = score - steps
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, np.arange(n + 1), 0))
        along = top + steps
        start = np.where(along > score, start[source], start)
        row, begin = np.maximum(score, along), start
        if row.max() > best:
            j = int(row.argmax())
            best, span = int(row[j]), (int(begin[j]), j)
    return best, *span


class Items:
    """A block of benchmark items with the places of their seeds."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.words = [], []
        self.seen, self.seen_bytes = {}, 0
        for i, text in zip(ids, texts, strict=True):
            w = words(np.frombuffer(text.encode(), np.uint8))
            if len(w) >= SEED:
                self.ids.append(i)
                self.words.append(w)
        grams = [T.to_signed(T.gram_hashes(w, SEED)) for w in self.words]
        self.seed = np.concatenate([np.zeros(0, np.int64), *grams])
        self.item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(g), k) for k, g in enumerate(grams))]).astype(np.int64)
        self.at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)]).astype(np.int64)
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.at = self.seed[order], self.item[order], self.at[order]
        self.keys = np.unique(self.seed)

    def _may_reach(self, i: int, text: np.ndarray, least: float) -> bool:
        """False only if no alignment can score ``least``: each match takes a word of the item and an equal one of the text."""
        item = self.words[i]
        n = len(item)
        if np.isin(item, text).sum() / n < least:
            return False
        held = np.append(0, np.cumsum(np.isin(text, item)))
        # at most n matches, and each further word of the range costs a point of the 2 * n * (1 - least) to spare
        width = min(len(text), n + int(2 * n * max(0.0, 1 - least)) + 1)
        return int((held[width:] - held[: len(held) - width]).max()) / n >= least

    def _aligned(self, i: int, text: np.ndarray) -> tuple[int, int, int]:
        """Copies of a passage are aligned once in a task."""
        key = (i, text.tobytes())
        if (found := self.seen.get(key)) is None:
            if self.seen_bytes > 32 << 20:
                self.seen, self.seen_bytes = {}, 0
            found = self.seen[key] = align(self.words[i], text)
            self.seen_bytes += len(key[1]) + 200
        return found

    def matches(self, data: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, end) for each item that reaches ``least`` in a text."""
        text = words(data)
        if len(text) < SEED or not len(self.keys):
            return []
        grams = T.to_signed(T.gram_hashes(text, SEED))
        hits = np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)] == grams)
        if not len(hits):
            return []
        lo, hi = np.searchsorted(self.seed, grams[hits]), np.searchsorted(self.seed, grams[hits], "right")
        place = np.repeat(hits, hi - lo)
        entry = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
        item, at = self.item[entry], self.at[entry]
        size = np.array([len(w) for w in self.words])[item]
        slack = size // 3 + 3
        first, end = np.maximum(0, place - at - slack), np.minimum(len(text), place - at + size + slack)
        order = np.lexsort((first, item))
        item, first, end = item[order], first[order], end[order]
        out: dict[int, tuple[int, float, int, int]] = {}
        k = 0
        while k < len(item):
            a, b, i = int(first[k]), int(end[k]), int(item[k])
            k += 1
            while k < len(item) and item[k] == i and first[k] <= b:
                b = max(b, int(end[k]))
                k += 1
            if not self._may_reach(i, text[a:b], least):
                continue
            points, x, y = self._aligned(i, text[a:b])
            score = points / (MATCH * len(self.words[i]))
            if score >= least and (i not in out or score > out[i][1]):
                out[i] = (self.ids[i], score, a + x, a + y)
        return list(out.values())


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Items]:
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = -(-total // block_bytes)
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows])


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word for each contaminated pair."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for ids, datas in T.each(batches):
                rows = [(d, *m) for d, data in zip(ids, datas, strict=True) for m in shared.value.matches(data, least)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "score", "start_word", "end_word"])

        out = out.union(docs.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept."""
    spark, out, place = docs.sparkSession, docs, docs.columns.index("text")
    for items in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.matches(data, least) for data in T.texts(batch.column(place))], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
