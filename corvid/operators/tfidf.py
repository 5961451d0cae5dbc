"""TF-IDF weights and search.

Terms are lower-cased word tokens of two characters or more, without stop
words, alone and in neighbouring pairs. The corpus is read twice and never
shuffled as tokens: the first pass sums the terms of each task before the
shuffle that ranks them; the vocabulary kept is bounded by ``limit``, so the
second pass has it by broadcast, weighs each document on its own and hands on
only the terms that are asked for.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from .search import BLOCK_BYTES, SCORE_BYTES, Running, best

_WORD = re.compile(r"\w{2,}")
_STOP = frozenset(C.STOP_WORDS)


def grams(text: str | None, pairs: bool = True) -> list[str]:
    """A text's terms; pairs are made after stop words are gone."""
    kept = [w for w in _WORD.findall((text or "").lower()) if w not in _STOP]
    return kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])] if pairs else kept  # noqa: B905


def term_stats(docs: DataFrame, limit: int = C.TFIDF_FEATURES, pairs: bool = True, text: str = "text", parsed: bool = False) -> DataFrame:
    """(term, total, df, idf) of the ``limit`` most frequent terms, ties in alphabetical order.

    Words are counted first. The total of the last of the ``limit`` most frequent words is a
    bound: a pair that is to be among the first has it, and so have both of its words. So only pairs
    of such words are counted, by number. Where that leaves too many words (ties), pairs are counted as they are.
    ``parsed``: texts are their kept words with a blank between.
    """
    sums = [F.sum("total").alias("total"), F.sum("df").alias("df")]
    words = docs.select(text).mapInArrow(_count_words(parsed), "term string, total long, df long").groupBy("term").agg(*sums)
    if pairs:
        words = words.persist()
        n, least = words.orderBy(F.desc("total")).limit(limit).agg(F.count(F.lit(1)), F.min("total")).first()
        kept = words.where(F.col("total") >= (least if n == limit else 1))
        known = [r[0] for r in kept.select("term").orderBy("term").limit(4 * limit + 1).collect()] if n == limit and least > 1 else None
        if known is not None and len(known) <= 4 * limit:
            numbers = docs.sparkSession.createDataFrame(list(enumerate(known)), "number long, term string")
            numbers = F.broadcast(numbers)
            counted = docs.select(text).mapInArrow(_count_pairs(docs.sparkSession.sparkContext.broadcast(known), parsed), "code long, total long, df long").groupBy("code").agg(*sums).where(F.col("total") >= least)
            one, two = numbers.withColumnsRenamed({"number": "a", "term": "first"}), numbers.withColumnsRenamed({"number": "b", "term": "second"})
            counted = counted.withColumns({"a": F.expr(f"code div {len(known)}"), "b": F.col("code") % len(known)}).join(one, "a").join(two, "b").select(F.concat_ws(" ", "first", "second").alias("term"), "total", "df")
            words = kept.union(counted)
        else:
            words = words.union(docs.select(text).mapInArrow(_count_any_pairs(parsed), "term string, total long, df long").groupBy("term").agg(*sums))
    top = words.orderBy(F.desc("total"), F.asc("term")).limit(limit)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))  # one row
    return top.join(F.broadcast(n_docs), how="cross").withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).drop("n_docs")


def _slices(batches: Iterator[pa.RecordBatch], column: int = 0, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about ``most`` bytes of text (one text may have more)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def split(column: pa.Array, parsed: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after the other, and the text of each; ``parsed`` as in ``term_stats``."""
    if parsed:
        lists = pc.split_pattern(column, " ")
        words, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    else:
        found = [grams(x, False) for x in column.to_pylist()]
        words, sizes = pa.array(itertools.chain.from_iterable(found), pa.string()), np.array([len(x) for x in found], np.int64)
    return words, np.repeat(np.arange(len(sizes)), sizes)


def numbers(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word in ``known``, -1 where it is not there."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, how often each is there, and in how many texts; owners come in order."""
    if not len(codes):
        return codes, codes, codes
    n = int(owner[-1]) + 1
    own, times = np.unique(codes * n + owner, return_counts=True)
    own //= n
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    return own[starts], np.add.reduceat(times, starts), np.diff(np.append(starts, len(own)))


def _count_words(parsed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, owner = split(batch.column(0), parsed)
            words = words.dictionary_encode()
            codes, total, df = _sums(words.indices.to_numpy().astype(np.int64), owner)
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(codes)), pa.array(total), pa.array(df)], ["term", "total", "df"])

    return run


def neighbours(owner: np.ndarray) -> np.ndarray:
    """Places of words followed by another word of the same text."""
    return np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)


def _count_pairs(known, parsed: bool):
    def run(batches):
        frequent = pa.array(known.value, pa.string())
        for batch in _slices(batches):
            words, owner = split(batch.column(0), parsed)
            words = numbers(words, frequent)
            at = neighbours(owner)
            at = at[(words[at] >= 0) & (words[at + 1] >= 0)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _sums(words[at] * len(frequent) + words[at + 1], owner[at])], ["code", "total", "df"])

    return run


def _count_any_pairs(parsed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, owner = split(batch.column(0), parsed)
            words = words.dictionary_encode()
            codes, names = words.indices.to_numpy().astype(np.int64), words.dictionary
            at = neighbours(owner)
            pairs, total, df = _sums(codes[at] * len(names) + codes[at + 1], owner[at])
            n = max(len(names), 1)
            terms = pc.binary_join_element_wise(names.take(pa.array(pairs // n)), names.take(pa.array(pairs % n)), " ")
            yield pa.RecordBatch.from_arrays([terms, pa.array(total), pa.array(df)], ["term", "total", "df"])

    return run


def vocabulary(stats: DataFrame) -> dict[str, float]:
    """term -> idf, as many as ``term_stats`` was limited to."""
    return {r[0]: r[1] for r in stats.select("term", "idf").collect()}


def weights(docs: DataFrame, idf: dict[str, float], key: str, pairs: bool = True, text: str = "text", only: frozenset | None = None) -> DataFrame:
    """(key, term, weight), each document's weights of unit length; ``only`` limits the terms handed on."""
    shared = docs.sparkSession.sparkContext.broadcast((idf, only))

    def weigh(batches):
        known, asked = shared.value
        for batch in _slices(batches, 1):
            keys, terms, values = [], [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {t: n * known[t] for t, n in Counter(grams(x, pairs)).items() if t in known}
                size = sum(w * w for w in own.values()) ** 0.5
                for t, w in own.items():
                    if asked is None or t in asked:
                        keys.append(k)
                        terms.append(t)
                        values.append(w / size)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(terms, pa.string()), pa.array(values, pa.float64())], [key, "term", "weight"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(weigh, f"{key} long, term string, weight double")


class Scorer:
    """Scores texts against questions: a product of two sparse matrices of unit rows, in memory for a batch.

    Terms are numbered in the vocabulary's alphabetical order.
    """

    def __init__(self, idf: dict[str, float], questions: list[str | None], pairs: bool = True):
        self.idf, self.pairs, self.count = idf, pairs, len(questions)
        self.number = {t: i for i, t in enumerate(sorted(idf))}
        asked: dict[int, list[tuple[int, float]]] = {}
        for q, text in enumerate(questions):
            for term, w in zip(*self.unit(text), strict=True):
                asked.setdefault(term, []).append((q, w))
        self.asked = {t: (np.array([q for q, _ in x]), np.array([w for _, w in x])) for t, x in asked.items()}
        self.wanted = np.zeros(len(idf), bool)
        self.wanted[list(asked)] = True

    def unit(self, text: str | None) -> tuple[list[int], list[float]]:
        """Numbers and weights of a text's terms."""
        own = [(self.number[t], n * self.idf[t]) for t, n in Counter(grams(text, self.pairs)).items() if t in self.idf]
        size = sum(w * w for _, w in own) ** 0.5
        return [t for t, _ in own], [w / size for _, w in own]

    def product(self, terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Questions by texts; terms and weights of the texts stand one after the other, ``sizes`` of each text."""
        out = np.zeros((self.count, len(sizes)))
        on = self.wanted[terms]
        terms, weights, rows = terms[on], weights[on], np.repeat(np.arange(len(sizes)), sizes)[on]
        order = np.argsort(terms, kind="stable")
        terms, weights, rows = terms[order], weights[order], rows[order]
        edges = np.flatnonzero(np.diff(terms, prepend=-1, append=-1)) if len(terms) else []
        for lo, hi in itertools.pairwise(edges):
            qs, ws = self.asked[int(terms[lo])]
            out[qs[:, None], rows[None, lo:hi]] += ws[:, None] * weights[None, lo:hi]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Questions by texts."""
        found = [self.unit(x) for x in texts]
        flat = lambda k, kind: np.array([x for own in found for x in own[k]], kind)
        return self.product(flat(0, np.int64), flat(1, float), np.array([len(t) for t, _ in found], np.int64))


def weighed(docs: DataFrame, idf: dict[str, float], text: str = "text") -> DataFrame:
    """Adds ``terms`` and ``weights``: each text's term numbers in the vocabulary's order, and their weights of unit length."""
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(idf, []))
    place = docs.columns.index(text)

    def run(batches):
        for batch in _slices(batches, place):
            found = [scorer.value.unit(x) for x in batch.column(place).to_pylist()]
            more = [pa.array([t for t, _ in found], pa.list_(pa.int32())), pa.array([w for _, w in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "terms", "weights"])

    names = ", ".join(f"`{n}` {kind}" for n, kind in docs.dtypes)
    return docs.mapInArrow(run, f"{names}, terms array<int>, weights array<double>")


def sparse_scores(scorer: Scorer, terms: int, weights: int):
    """TF-IDF products of questions with a batch's columns of term numbers and weights."""
    return functools.partial(_sparse, scorer, terms, weights)


def _sparse(scorer: Scorer, terms: int, weights: int, batch: pa.RecordBatch) -> np.ndarray:
    own, values = batch.column(terms), batch.column(weights)
    return scorer.product(own.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False), np.diff(own.offsets.to_numpy()))


def search(questions: DataFrame, docs: DataFrame, k: int = C.TOP_K, limit: int = C.TFIDF_FEATURES, digits: int = 6) -> DataFrame:
    """query_id, id, score, rank of the best ``k`` of ``docs (id, text)`` for each of ``questions (query_id, text)``; texts that share no term are left out.

    Questions are the stated query set, broadcast in blocks of bounded size;
    each task hands on the best ``k`` of its documents.
    """
    spark, schema = docs.sparkSession, "query_id long, id long, score double"
    idf = vocabulary(term_stats(docs, limit))
    hits = spark.createDataFrame([], schema)
    total = questions.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    count = -(-total // BLOCK_BYTES)
    for block in range(count):
        rows = questions.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == block).orderBy("query_id").toPandas()
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(np.int64), Scorer(idf, rows["text"].tolist())))

        def run(batches, shared=shared):
            own, scorer = shared.value
            held = Running(len(own), k)
            for batch in _slices(batches, 1):
                step = max(1, SCORE_BYTES // (16 * len(own)))
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    ids, score = part.column(0).to_numpy(), np.round(scorer.scores(part.column(1).to_pylist()), digits)
                    held.room(len(ids))
                    held.add(0, len(own), -score, ids)
            for which, ids, order in held.parts(own):
                some = order < 0
                yield pa.RecordBatch.from_arrays([pa.array(which[some]), pa.array(ids[some]), pa.array(-order[some])], ["query_id", "id", "score"])

        hits = hits.union(docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, schema))
    return best(hits, k, "score", descending=True)
