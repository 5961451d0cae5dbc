"""Language identification with bit-sliced Bloom filters.

One filter is kept for each language, all of the same size and with the same
hash functions, stored slice by slice: each slot is an integer whose bit L
tells whether filter L has that slot. One look-up of an n-gram (the AND of its
slots) thus returns the set of all languages that contain it. A text's n-grams
are looked up at once; the number of n-grams that a language holds, less those
expected from the filter's false positives, decides.

The n-grams are runs of four bytes of the text, A-Z lower-cased, other ASCII
characters than letters turned into one blank. A language learns those that
make up at least ``least_share`` of its n-grams, hence at most ``1 /
least_share`` of them; counts run over all training rows and are summed before
they are shuffled. What is collected and broadcast has that bound.

Null texts and texts without a letter are ``und`` with score 0. Rows with a
null language or text teach nothing. Ties go to the language first in
alphabetical order. With nothing learned every text is ``und``. Repeated rows
are judged alike; extra columns are ignored. At most 64 languages; more raise
``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

U64 = T.U64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(data: np.ndarray) -> np.ndarray:
    """The four-byte n-grams of a text, as integers, in order."""
    folded = np.concatenate([np.array([32], np.uint8), _FOLD[data], np.array([32], np.uint8)])
    blank = folded == 32
    folded = folded[np.append(True, ~(blank[1:] & blank[:-1]))].astype(np.uint32)
    if len(folded) < 4:
        return np.zeros(0, np.uint32)
    return folded[:-3] << 24 | folded[1:-2] << 16 | folded[2:-1] << 8 | folded[3:]


def has_letter(data: np.ndarray) -> bool:
    if (_FOLD[data] != 32).any() and bool(((data >= 65) & (data <= 90) | (data >= 97) & (data <= 122)).any()):
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "ignore"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}

    def settle(lang):
        keys, counts = total.get(lang, (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
        new, first = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        both, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
        total[lang] = both, np.bincount(where, np.concatenate([counts, first]), len(both)).astype(np.int64)

    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for lang, data in zip(langs, T.texts(batch.column(batch.schema.get_field_index("text"))), strict=True):
            waiting.setdefault(lang, []).append(grams(data))
            if len(waiting[lang]) >= 512 or len(data) > 1 << 20:
                settle(lang)
    for lang in list(waiting):
        settle(lang)
    for lang, (keys, counts) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


class Filters:
    """Bloom filters of all languages, one integer of language bits for each slot."""

    HASHES = 3

    def __init__(self, learned: dict[str, np.ndarray]):
        self.languages = sorted(learned)
        if len(self.languages) > 64:
            raise ValueError("at most 64 languages fit the mask")
        most = max([len(g) for g in learned.values()], default=1)
        self.slots = 1 << max(10, int(np.ceil(np.log2(12 * max(most, 1)))))
        self.masks = np.zeros(self.slots, np.uint64)
        self.false = np.zeros(len(self.languages))
        for bit, lang in enumerate(self.languages):
            for at in self._places(learned[lang]):
                self.masks[at] |= U64(1 << bit)
            self.false[bit] = float(((self.masks >> U64(bit)) & U64(1)).mean()) ** self.HASHES

    def _places(self, keys: np.ndarray) -> list[np.ndarray]:
        h = T.mix(keys.astype(np.uint64) + U64(0x2545F4914F6CDD1D))
        return [((h + U64(k) * (T.mix(h) | U64(1))) >> U64(20)).astype(np.int64) & (self.slots - 1) for k in range(self.HASHES)]

    def held(self, keys: np.ndarray) -> np.ndarray:
        """The language bits of each n-gram."""
        out = np.full(len(keys), np.iinfo(np.uint64).max, np.uint64)
        for at in self._places(keys):
            out &= self.masks[at]
        return out

    def decide(self, data: np.ndarray) -> tuple[str, float, float]:
        """Language, score (lead over the next language, 0 to 1) and share of known n-grams."""
        keys = grams(data)
        if not self.languages or not len(keys) or not has_letter(data):
            return "und", 0.0, 0.0
        bits = self.held(keys)
        found = np.array([int(((bits >> U64(k)) & U64(1)).sum()) for k in range(len(self.languages))], float)
        found = np.maximum(0.0, (found - len(keys) * self.false) / (1 - self.false))
        best = int(found.argmax())
        rest = float(np.delete(found, best).max()) if len(found) > 1 else 0.0
        return self.languages[best], float(min(1.0, (found[best] - rest) / found[best])) if found[best] > 0 else 0.0, float(min(1.0, found[best] / len(keys)))


def learn(docs: DataFrame, least_share: float = 2e-5) -> Filters:
    """Filters from all rows of ``docs`` that have a language and a text."""
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    if total.count() > 64:
        raise ValueError("at most 64 languages fit the mask")
    kept = counts.join(F.broadcast(total), "lang").where(F.col("n") >= F.col("total") * least_share).select("lang", "gram").toPandas()
    return Filters({lang: np.sort(part["gram"].to_numpy()).astype(np.uint32) for lang, part in kept.groupby("lang")})


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score and coverage of each row; reads only the text."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        f = shared.value
        for ids, datas in T.each(batches):
            rows = [f.decide(data) for data in datas]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64())))], ["doc_id", "lang_pred", "score", "coverage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, coverage double")


def keep_identified(docs: DataFrame, filters: Filters, least_coverage: float = 0.1) -> DataFrame:
    """The rows whose text is in a learned language: not ``und``, and a tenth of its n-grams known."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema, place = docs.schema, docs.columns.index("text")

    def run(batches):
        f = shared.value
        for batch in batches:
            good = [(v := f.decide(data))[0] != "und" and v[2] >= least_coverage for data in T.texts(batch.column(place))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, schema)
