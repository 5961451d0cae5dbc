"""Substring dedup by recompression.

Every document is parsed by rounds of recompression. A round first names runs
of one symbol (by the symbol and the run's length), then each symbol draws a
side from its own name, and a left symbol followed by a right one becomes a
pair, whose name is a function of both names. Names are 64-bit functions of
content, so all executors agree on them without exchanging a dictionary; Spark
then brings equal names together. Where two texts are equal, their parses are
equal but for a few symbols at either end.

*High symbols.* After ``ROUNDS`` rounds a symbol stands for some words. A symbol
with those that follow it until every window that starts in it is inside is a
*stretch*. Equal names of a stretch (64 bits of its symbols' names, 32 of
its words) mean equal words, so a stretch that a document of smaller doc_id has
too is verified at once: all windows in it are repeats. That settles the inside
of long repeats by one row for each high symbol.

*Low symbols* find what remains: the ends of long repeats and short ones. The
first two rounds name no runs (equal neighbours draw equal sides, so they never
pair); a phrase boundary after them depends on the three words before and the
three after it only. A boundary's symbol names the eight words around it (three
before, five after). A window of 13 words sees between one and six boundaries
whose symbol lies inside it (any four neighbouring places hold one); the least
of these names is the window's symbol. So equal windows have equal symbols, and
a window whose symbol occurs in one document only cannot repeat. Windows under
shared symbols that no stretch settled are verified by a 96-bit name of all
their words. A settled window is never missed as the first of its kind: the
smallest document that has it has no smaller one to settle it.

Steps, with what is shuffled:

1. whole documents with equal word sequences (the root symbol of the parse)
   are found by a 128-bit name: one short row for each document;
2. low symbols with the least and largest document that has them, summed
   before the shuffle; about 0.3 rows a word;
3. documents that hold shared symbols are joined with their texts;
4. their stretches: least document for each, one row a high symbol; those that
   a smaller document has are joined with the texts;
5. their other windows under shared symbols: least document for each window.

Hot symbols, stretches or windows never gather in one task: steps 2, 4 and 5
aggregate partially before their shuffle and write the sums, so the joins that
follow are plain equi-joins of two tables, whose skewed partitions Spark splits.

Nulls, empty and short texts (fewer than ``window`` words) lose nothing. Of
equal windows, the one in the smallest doc_id stays; repeats inside one
document stay. Rows with equal doc_id count as one document's rows for
"smaller", and each loses words by its own text; null doc_id rows are returned
with nothing removed. An empty table gives an empty result. Extra columns are
ignored. Very long texts are parsed as a whole, in about 100 times their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import materialize, release

U64 = T.U64
BEFORE, SPAN = 3, 8
LOW, ROUNDS = 2, 6
#: Bytes of text parsed at once.
MOST = (1 << 20) - 1024


def parse(words: np.ndarray, opens: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after so many rounds; ``opens`` marks the words that open a document."""
    names, starts, edge = words, np.arange(len(words)), opens
    for level in range(rounds):
        if level >= LOW:
            first = np.flatnonzero(np.append(True, names[1:] != names[:-1]) | edge)
            length = np.diff(np.append(first, len(names))).astype(np.uint64)
            names = np.where(length == 1, names[first], T.mix(names[first] * U64(0xE7037ED1A0B428DB) + length))
            starts, edge = starts[first], edge[first]
        side = T.mix(names + U64(0x5851F42D4C957F2D * (level + 1) & (2**64 - 1))) >> U64(63)
        new = edge.copy()
        new[1:] |= ~((side[:-1] == 0) & (side[1:] == 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(names)) - 1
        pair = T.mix(names[first] * U64(0xA0761D6478BD642F) + names[last] + U64(level + 1))
        names, starts, edge = np.where(first == last, names[first], pair), starts[first], edge[first]
    return names, starts


def _alone(words: np.ndarray) -> np.ndarray:
    """``opens`` of one document."""
    opens = np.zeros(len(words), bool)
    opens[:1] = True
    return opens


def window_symbols(words: np.ndarray, window: int = 13, opens: np.ndarray | None = None) -> np.ndarray:
    """The low symbol of each run of ``window`` words (see above); those that cross documents mean nothing."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64)
    reach = window - SPAN + 1  # so many places for a boundary
    here = np.zeros(n, bool)
    here[parse(words, _alone(words) if opens is None else opens, LOW)[1]] = True
    names = np.full(n + 1, np.iinfo(np.uint64).max, np.uint64)
    grams = T.gram_hashes(words, SPAN) >> U64(1)
    names[BEFORE : BEFORE + len(grams)] = np.where(here[BEFORE : BEFORE + len(grams)], grams, np.iinfo(np.uint64).max)
    count = n - window + 1
    out = names[BEFORE : BEFORE + count].copy()
    for k in range(1, reach):
        np.minimum(out, names[BEFORE + k : BEFORE + k + count], out=out)
    return out


def stretches(words: np.ndarray, window: int = 13, opens: np.ndarray | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Names (64 and 32 bits), first words and lengths of the stretches; ``ends``: for each word, where its document ends."""
    if not len(words):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    names, starts = parse(words, _alone(words) if opens is None else opens, ROUNDS)
    ends = np.full(len(words), len(words)) if ends is None else ends
    bounds = np.append(starts, len(words))
    # up to the first boundary that leaves no window that starts in the symbol outside
    upto = np.searchsorted(bounds, bounds[1:] + window - 1)
    at = np.flatnonzero(upto < len(bounds))
    at = at[bounds[upto[at]] <= ends[starts[at]]]
    upto = upto[at]
    return T.span_hashes(names, at, upto), T.span_hashes(words, bounds[at], bounds[upto]) >> U64(32), bounds[at], bounds[upto] - bounds[at]


class _Words:
    """The words of some documents in one array, with the documents' bounds and tags.

    A tag has 31 bits that tell texts of one doc_id apart, in the upper half of a position.
    """

    def __init__(self, datas: list[np.ndarray]):
        data = np.frombuffer(b"\n".join([d.tobytes() for d in datas]), np.uint8)
        lo, hi = T.word_bounds(data)
        self.hashes = T.word_hashes(data, lo, hi)
        opened = np.cumsum([0] + [len(d) + 1 for d in datas])
        self.bounds = np.searchsorted(lo, opened)
        counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(datas)), counts)
        self.ends = np.repeat(self.bounds[1:], counts)
        self.at = np.arange(len(lo)) - np.repeat(self.bounds[:-1], counts)
        self.opens = self.at == 0
        total = np.zeros(len(lo) + 1, np.uint64)
        np.cumsum(T.mix(self.hashes * T.powers(0xA24BAED4963EE407 | 1, len(lo))[self.at]), out=total[1:])
        self.tags = (total[self.bounds[1:]] - total[self.bounds[:-1]]) >> U64(33) << U64(32)

    def windows(self, window: int) -> np.ndarray:
        """Where windows start that end inside their document."""
        return np.flatnonzero(np.arange(len(self.hashes)) + window <= self.ends)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, datas in T.each(batches):
        rows = []
        for d, data in zip(ids, datas, strict=True):
            words = data.tobytes().split()
            digest = hashlib.sha256(b" ".join(words)).digest()
            rows.append((d, len(words), digest))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n_words", "sha"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, _Words]]:
    """Parts of batches with a doc_id, their doc_ids and words."""
    for batch in batches:
        for part in T.parts(batch.filter(batch.column("doc_id").is_valid()), most_bytes=MOST):
            yield part, part.column("doc_id").to_numpy(), _Words(list(T.texts(part.column("text"))))


def _symbols(window: int):
    def run(batches):
        for _, ids, words in _read(batches):
            at = words.windows(window)
            if len(at):
                s, doc = window_symbols(words.hashes, window, words.opens)[at], words.doc[at]
                new = np.append(True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(T.to_signed(s[new])), pa.array(ids[doc[new]])], ["symbol", "doc_id"])

    return run


def _positions(words: _Words, at: np.ndarray) -> pa.Array:
    return pa.array(T.to_signed(words.at[at].astype(np.uint64) + words.tags[words.doc[at]]))


def _stretches(window: int):
    def run(batches):
        for _, ids, words in _read(batches):
            a, b, at, length = stretches(words.hashes, window, words.opens, words.ends)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(T.to_signed(a)), pa.array(b.astype(np.int32)), pa.array(ids[words.doc[at]]), _positions(words, at), pa.array(length.astype(np.int32))], ["a", "b", "doc_id", "pos", "len"])

    return run


def _windows(window: int):
    def run(batches):
        for part, ids, words in _read(batches):
            at = words.windows(window)
            shared = np.unique(part.column("symbols").flatten().to_numpy()).view(np.uint64)
            if not len(at) or not len(shared):
                continue
            own = window_symbols(words.hashes, window, words.opens)[at]
            shared = np.sort(shared)
            at = at[shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own]
            # windows in settled stretches need no look
            doc, pos, length = _spans(part.column("spans"))
            mine = words.tags[doc] >> U64(32) == pos.view(np.uint64) >> U64(32)
            first = words.bounds[doc[mine]] + (pos[mine] & 0xFFFFFFFF)
            at = at[~covered(len(words.hashes), first, length[mine] - window + 1)[at]]
            if len(at):
                a, b = (T.gram_hashes(words.hashes, window, *mult)[at] for mult in ((), (0xC2B2AE3D27D4EB4F,)))
                yield pa.RecordBatch.from_arrays([pa.array(T.to_signed(a)), pa.array((T.to_signed(b) >> 32).astype(np.int32)), pa.array(ids[words.doc[at]]), _positions(words, at)], ["a", "b", "doc_id", "pos"])

    return run


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and length of each stretch in a column of lists."""
    flat = column.flatten()
    doc = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())
    return doc, flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64)


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in a run that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0


def _cut(window: int, keep_text: bool):
    def run(batches):
        for part, ids, words in _read(batches):
            doc, pos, length = _spans(part.column("spans"))
            starts = part.column("starts")
            doc = np.append(doc, np.repeat(np.arange(len(ids)), starts.value_lengths().fill_null(0).to_numpy()))
            pos = np.append(pos, starts.flatten().to_numpy())
            length = np.append(length, np.full(len(pos) - len(length), window))
            mine = words.tags[doc] >> U64(32) == pos.view(np.uint64) >> U64(32)
            gone = covered(len(words.hashes), words.bounds[doc[mine]] + (pos[mine] & 0xFFFFFFFF), length[mine])
            rows = []
            for i, (d, data) in enumerate(zip(ids.tolist(), T.texts(part.column("text")), strict=True)):
                out, own = gone[words.bounds[i] : words.bounds[i + 1]], data.tobytes().split()
                kept = b" ".join([w for w, g in zip(own, out.tolist(), strict=True) if not g])
                rows.append((d, hashlib.sha256(b" ".join(own)).digest(), int(out.sum()), hashlib.sha256(kept).digest(), kept.decode() if keep_text else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string()))], ["doc_id", "sha", "n_removed", "kept_sha", "kept_text"])

    return run


def _later(rows: DataFrame, tag: str) -> DataFrame:
    """The ``rows`` (a, b, doc_id, ...) whose name (a, b) a smaller doc_id has too."""
    least = rows.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a", "b", "lo")
    return rows.join(materialize(least, tag), ["a", "b"]).where("doc_id > lo")


def repeats(docs: DataFrame, window: int = 13, keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(profile, cut)``.

    profile: doc_id, n_words, sha (of all words), is_copy (its word sequence is
    that of a smaller doc_id), one row for each row of ``docs``.
    cut: doc_id, sha, n_removed, kept_sha, kept_text, for documents that lose words
    and are no copies.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = materialize(docs.mapInArrow(_profile, "doc_id long, n_words long, sha binary"), "profile")
    first = profile.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    first = materialize(first.where("copies > 1").select("sha", "first_id"), "first")
    read = profile
    profile = materialize(profile.join(first, "sha", "left").select("doc_id", "n_words", "sha", F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)).alias("is_copy")), "copies")
    release(read, first)
    symbols = docs.mapInArrow(_symbols(window), "symbol long, doc_id long")
    shared = materialize(symbols.groupBy("symbol").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("symbol"), "shared")
    held = materialize(symbols.join(shared, "symbol").groupBy("doc_id").agg(F.collect_set("symbol").alias("symbols")), "held")
    # documents whose every row is a copy are settled
    settled = profile.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("is_copy").alias("is_copy")).where("is_copy").select("doc_id")
    texts = materialize(docs.join(held.join(settled, "doc_id", "left_anti").hint("shuffle_hash"), "doc_id"), "texts")
    release(shared, held)
    # rows are made anew for either side of a join: a written table of them would take as much disk as the input
    high = texts.mapInArrow(_stretches(window), "a long, b int, doc_id long, pos long, len int")
    spans = _later(high, "stretches").groupBy("doc_id").agg(F.collect_set(F.struct("pos", "len")).alias("spans"))
    spans = materialize(spans, "spans")  # shuffle files can go before texts are joined
    read, texts = texts, materialize(texts.join(spans.hint("shuffle_hash"), "doc_id", "left"), "settled")
    release(read, spans)
    windows = texts.mapInArrow(_windows(window), "a long, b int, doc_id long, pos long")
    starts = materialize(_later(windows, "least").groupBy("doc_id").agg(F.collect_set("pos").alias("starts")), "starts")
    found = texts.select("doc_id", "text", "spans").join(starts.hint("shuffle_hash"), "doc_id", "left").where("spans is not null or starts is not null")
    cut = found.mapInArrow(_cut(window, keep_text), "doc_id long, sha binary, n_removed long, kept_sha binary, kept_text string").dropDuplicates(["doc_id", "sha"])
    return profile, cut


_EMPTY = hashlib.sha256(b"").hexdigest()


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs``.

    A word goes if a window of ``window`` words that covers it starts in a
    document of smaller doc_id too; windows are judged on the input.
    """
    profile, cut = repeats(docs, window)
    whole = F.col("is_copy") & (F.col("n_words") >= window)
    return profile.join(cut.select("doc_id", "sha", "n_removed", "kept_sha"), ["doc_id", "sha"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_EMPTY)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
    )


def drop_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` without the repeated words; rows left without words go.

    Untouched texts stay as they are. Changed ones are their kept words joined
    by one space, with n_chars (where the table has it) counted anew. Rows that
    share a doc_id are told apart by their words.
    """
    profile, cut = repeats(docs, window, keep_text=True)
    gone = profile.where(F.col("is_copy") & (F.col("n_words") >= window)).select("doc_id", "sha", F.lit("").alias("kept_text")).distinct()
    new = gone.union(cut.select("doc_id", "sha", "kept_text"))
    # the row as one value: its columns can't clash with those of this operator
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.sha2(F.array_join(F.regexp_extract_all(F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), " "), 256)
    texts = F.collect_list(F.struct("sha", "kept_text"))
    new = new.groupBy("doc_id").agg(texts.alias("new"))
    rows = rows.join(new.hint("shuffle_hash"), "doc_id", "left")
    same = F.filter("new", lambda x: F.lower(F.hex(x["sha"])) == own)[0]["kept_text"]
    changed = F.when(F.col("new").isNotNull(), same)
    rows = rows.select("row", changed.alias("kept_text"))
    changed = F.col("kept_text")
    columns = {name: F.col("row").getField(name) for name in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed.isNull(), columns["n_chars"]).otherwise(F.length(changed)).cast(docs.schema["n_chars"].dataType)
    columns["text"] = F.coalesce(changed, columns["text"])
    return rows.where(changed.isNull() | (changed != "")).select(*(c.alias(name) for name, c in columns.items()))
