"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are tokens: the words of a text (A-Z lower-cased), then one end. A
node is a context, the last one to ``max_depth`` tokens. Contexts are grown
level by level: a context, and a next symbol under it, is taken up if it occurs
``least_count`` times in training, however large the input. A context becomes a
node if its next-symbol distribution diverges from that of its longest proper
suffix: its count times the divergence (nats) must exceed what chance gives,
``1.5`` for each symbol plus ``10``. Contexts that fail the test predict as
their suffix does.

The tree is never in one place. Known n-grams stand in a written table for each
level, by a 64-bit hash; a level's distributions come from joins with the level
above and one window over the context. A text's score is a sum over its n-grams: with
suffixes and prefixes of a known n-gram known too, the probability of a position is
the root's, times the back-off weight of each context that is a node, times for
each known n-gram what it changes on that. So the tree becomes a table of values by
n-gram, without those of 0. The most frequent ``HEAD`` at most are broadcast; others
are joined by their hash. Before n-grams are counted or joined, a filter of ``BITS``
bits at most leaves out most that are not known; it lets through any that is.

Distributions are smoothed by absolute discounting: each counted symbol gives
``discount`` of its count to the parent's distribution; the root gives it to
one symbol that stands for all tokens never seen in training. The longest
suffix that is known scores each position.

Counts run over all training rows; each task sums its own before the shuffle.
Base score and root need the count of every token: of those of at least
``least_count`` the most frequent ``HEAD`` at most are broadcast, the others are
joined by their hash. The driver holds the filter, and of both broadcast tables a share of
some ``SHARE`` rows at a time. A Python worker holds both and the filter, at 24 bytes
a row at most, ``PART`` bytes of text (or one text) and ``MOST`` n-grams to be counted; broadcasts go
when the scores are written.

Nulls are empty texts: one token, the end. Rows with a null doc_id are scored
as held out. Repeated rows count as often as they occur; each row is scored by
itself. Without training rows every token is unseen and the root gives it all.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._store import materialize, release

#: Rows of a broadcast table and bits of a filter, at most.
HEAD, BITS = 1 << 22, 1 << 27
#: Rows of it that the driver holds at a time.
SHARE = 1 << 19
#: Bytes of text, n-grams to be counted, and rows handed on that a Python worker holds at a time; one text may have more.
PART, MOST, ROWS = 1 << 18, 1 << 19, 1 << 16
_END = np.uint64(1)
_MULT = np.uint64(0xD6E8FEB86659FD93)


def tokens(datas: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, one text after the other, as signed integers; the number of tokens of each text."""
    joined = np.frombuffer(b"\n".join(datas), np.uint8)
    starts, ends = T.word_bounds(joined)
    after = np.cumsum([len(data) + 1 for data in datas], dtype=np.int64)
    sizes = np.diff(np.searchsorted(starts, after), prepend=0) + 1
    out = np.full(len(starts) + len(datas), _END)
    word = np.ones(len(out), bool)
    word[np.cumsum(sizes) - 1] = False
    out[word] = T.word_hashes(joined, starts, ends, lower=True)
    return T.to_signed(out), sizes


def _scrambled(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class _Index:
    """Places of distinct integers, found by buckets of their scrambled values; those in that order need no further memory for places."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.int64, copy=False)
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        bucket = self._bucket(self.keys)
        self.place = None if np.all(bucket[1:] >= bucket[:-1]) else np.argsort(bucket, kind="stable").astype(np.int32)
        self.start = np.append(0, np.cumsum(np.bincount(bucket, minlength=1 << (64 - int(self.shift))))).astype(np.int32)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (_scrambled(keys) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys``, -1 where absent."""
        keys = np.ascontiguousarray(keys, dtype=np.int64)
        out = np.full(len(keys), -1, np.int64)
        bucket = self._bucket(keys)
        at, end = self.start[bucket], self.start[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end, keys = at[left], end[left], keys[left]
        while len(left):
            place = at if self.place is None else self.place[at]
            hit = self.keys[place] == keys
            out[left[hit]] = place[hit]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end, keys = left[more], at[more], end[more], keys[more]
        return out


def _before(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What stands one position earlier in the same text, -1 at its first."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[np.cumsum(sizes) - sizes] = -1
    return out


class Grams:
    """Known n-grams in memory, by length; one of length k is numbered by its prefix's number and its last word."""

    def __init__(self, words: np.ndarray):
        self.words = words  # sorted hashes
        self.codes: list[np.ndarray] = []  # for lengths 2, 3, ...: prefix * len(words) + word, sorted
        self._indexes: list[_Index] = []

    def __getstate__(self):
        return self.__dict__ | {"_indexes": []}  # each process makes its own

    def index(self, k: int) -> _Index:
        """Finds n-grams of length k + 1: words by their hash, others by their code."""
        while len(self._indexes) <= k:
            self._indexes.append(_Index([self.words, *self.codes][len(self._indexes)]))
        return self._indexes[k]

    def numbers(self, hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """For each length the number of the known n-gram that ends at each position, else -1; texts have ``sizes`` tokens."""
        word = self.index(0).find(hashes)
        out = [word]
        for k in range(1, len(self.codes) + 1):
            prefix = _before(out[-1], sizes)
            both = np.flatnonzero((prefix >= 0) & (word >= 0))
            here = np.full(len(word), -1, np.int64)
            here[both] = self.index(k).find(prefix[both] * len(self.words) + word[both])
            out.append(here)
        return out


def _longer(shorter: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those without the last word, and that word; the key of one word is its hash."""
    return T.mix(shorter.view(np.uint64) * _MULT + words.view(np.uint64)).view(np.int64)


def keys(hashes: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """For each length to ``most`` the keys of n-grams that end at each position; no n-gram ends within a text's first ones."""
    out = [hashes]
    for _ in range(most - 1):
        key = np.zeros_like(hashes)
        key[1:] = _longer(out[-1][:-1], hashes[1:])
        out.append(key)
    return out


def _places(sizes: np.ndarray) -> np.ndarray:
    """Of each token its place in its text."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _filter(rows: DataFrame, n: int) -> np.ndarray:
    """Bits of the ``n`` keys of ``rows``, 16 for each, but ``BITS`` at most."""
    size = min(BITS, 1 << max(6, (16 * n).bit_length()))
    bit = f"(key & {size - 1}L)"
    found = rows.groupBy(F.expr(f"shiftright({bit}, 6)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(key & 63L))")).alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    for batch in found.to_batches():  # columns are not copied into one
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def _may(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether keys may be among those of the filter."""
    return (bits[(found & (len(bits) * 64 - 1)) >> 6] >> (found & 63)) & 1 == 1


def _counting(of, names: list[str]):
    """A mapper that counts the rows (columns of 64 bits) which ``of`` makes from texts' token hashes; sums are handed on for each ``MOST``."""

    def summed(found):
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        found.clear()
        code = columns[0] if len(columns) == 1 else _longer(*columns)
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        n = np.diff(np.append(first, len(code)))
        order = order[first]
        for lo in range(0, len(order), ROWS):
            at = order[lo : lo + ROWS]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in columns), pa.array(n[lo : lo + ROWS])], [*names, "n"])

    def run(batches):
        found, size = [], 0
        for part in (part for batch in batches for part in T.parts(batch, most_bytes=PART)):
            found.append(of(*tokens(list(T.texts(part.column(part.schema.get_field_index("text")))))))
            size += len(found[-1][0])
            if size >= MOST:
                yield from summed(found)
                found, size = [], 0
        if size:
            yield from summed(found)

    return run


def _counts(rows: DataFrame, of, *names: str) -> DataFrame:
    kinds = ", ".join(f"{n} long" for n in (*names, "n"))
    found = rows.mapInArrow(_counting(of, list(names)), kinds)
    if len(names) > 1:  # few of a task's n-grams repeat beyond its own sums, so no table of them is kept before the shuffle
        found = found.repartition(*names)
    return found.groupBy(*names).agg(F.sum("n").alias("n"))


def _frequent(rows: DataFrame):
    """A condition, by ``n``, that at most ``HEAD`` rows meet: the most frequent ones."""
    step = F.floor(F.log2("n") * 16)
    total, least = 0, None
    for at, n in sorted(rows.groupBy(step).count().collect(), reverse=True):
        total += n
        if total > HEAD:
            break
        least = at
    return F.lit(False) if least is None else step >= least


def _shares(rows: DataFrame, *columns: str) -> Iterator[list[np.ndarray]]:
    """Some columns of at most ``HEAD`` rows: a power of two of shares, by the last bits of the key, with some ``SHARE`` rows each."""
    count = 1 << max(0, (rows.count() - 1) // SHARE).bit_length()
    for share in range(count):
        found = rows.where(F.expr(f"key & {count - 1}L") == share).select(*columns).toArrow()
        yield [found[c].to_numpy() for c in columns]


def _packed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A share in the order of its index; counts in as few bytes as they need."""
    order = np.argsort(_scrambled(key))
    values = values[order]
    return key[order], values.astype(np.min_scalar_type(values.max())) if values.dtype == np.int64 and len(values) else values


def _broadcast(rows: DataFrame, *columns: str) -> list:
    """Broadcasts of the shares of a table; the driver holds one at a time."""
    context = rows.sparkSession.sparkContext
    return [context.broadcast(_packed(*own)) for own in _shares(rows, *columns)]


class Shares:
    """Values by key, in the shares that ``_broadcast`` made of a table."""

    def __init__(self, shares: list[tuple[np.ndarray, np.ndarray]]):
        self.indexes, self.values = [_Index(key) for key, _ in shares], [value for _, value in shares]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the values of those."""
        hit, out = np.zeros(len(keys), bool), np.zeros(len(keys))
        last = keys & (len(self.indexes) - 1)
        for share, (index, values) in enumerate(zip(self.indexes, self.values, strict=True)):
            on = np.flatnonzero(last == share)
            place = index.find(keys[on])
            on, place = on[place >= 0], place[place >= 0]
            hit[on], out[on] = True, values[place]
        return hit, out[hit]


class Tree:
    """A tree in memory, to compare with: log10 probabilities of known n-grams' last symbols, log10 back-off weights of contexts."""

    def __init__(self, grams: Grams, logs: list[np.ndarray], backs: list[np.ndarray]):
        self.grams, self.logs, self.backs = grams, logs, backs

    def scores(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its log10 probability without the root's share for unknown words; which words those are; numbers of all words."""
        numbers = self.grams.numbers(hashes, sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        total, open_ = np.zeros(len(sizes)), np.arange(len(hashes))

        def add(where: np.ndarray, values: np.ndarray) -> None:
            nonlocal total
            total = total + np.bincount(text[where], values, len(sizes))

        for k in range(len(numbers) - 1, 0, -1):
            context = _before(numbers[k - 1], sizes)[open_]
            hit = numbers[k][open_] >= 0
            add(open_[hit], self.logs[k][numbers[k][open_[hit]]])
            missed = (context >= 0) & ~hit
            add(open_[missed], self.backs[k - 1][context[missed]])
            open_ = open_[~hit]
        known = numbers[0][open_] >= 0
        add(open_[known], self.logs[0][numbers[0][open_[known]]])
        return total, open_[~known], numbers[0]

    def score(self, hashes: np.ndarray) -> tuple[float, np.ndarray]:
        """``scores`` of one text."""
        total, open_, _ = self.scores(hashes, np.array([len(hashes)]))
        return float(total[0]), open_


def pruned(tree: Tree) -> Tree:
    """The tree without entries that predict as their suffix does and lead to no other."""
    codes, logs, backs = list(tree.grams.codes), list(tree.logs), list(tree.backs)
    width = max(len(tree.grams.words), 1)
    for k in range(len(codes), 0, -1):  # entries of length k + 1
        keep = backs[k - 1][codes[k - 1] // width] != 0
        if k < len(backs):
            keep |= backs[k] != 0
        if k < len(codes):
            keep[codes[k] // width] = True
            codes[k] = (np.cumsum(keep) - 1)[codes[k] // width] * width + codes[k] % width
        codes[k - 1], logs[k] = codes[k - 1][keep], logs[k][keep]
        if k < len(backs):
            backs[k] = backs[k][keep]
    grams = Grams(tree.grams.words)
    grams.codes = codes
    return Tree(grams, logs, backs)


def _level(found: DataFrame, above: DataFrame, depth: int, discount: float) -> DataFrame:
    """n-grams (key, suffix, n, prob) of one length with their prefix, and what the prefix is as a context.

    ``found``: prefix, word, n. ``above``: n-grams that are shorter by one.
    """

    def named(batches):
        for batch in batches:
            prefix, word, short = (batch.column(i).to_numpy() for i in range(3))
            suffix = word if depth == 1 else _longer(short, word)
            yield pa.RecordBatch.from_arrays([pa.array(_longer(prefix, word)), pa.array(suffix), batch.column(0), *batch.columns[3:]], ["key", "suffix", "prefix", "n", "of"])

    rows = found.join(above.select(F.col("key").alias("prefix"), F.col("suffix").alias("short"), F.col("n").alias("of")), "prefix")
    rows = rows.select("prefix", "word", "short", "n", "of").mapInArrow(named, "key long, suffix long, prefix long, n long, of long")
    rows = rows.join(above.select(F.col("key").alias("suffix"), F.col("prob").alias("less")), "suffix")
    group = Window.partitionBy("prefix").orderBy("key")
    all_ = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("back", F.greatest(F.lit(1e-12), 1.0 - F.sum(F.col("n") - discount).over(all_) / F.col("of")))
    rows = rows.withColumn("own", (F.col("n") - discount) / F.col("of") + F.col("back") * F.col("less"))
    gap = F.sum(F.col("n") * F.log(F.col("own") / F.col("less"))).over(all_)
    rows = rows.withColumns({"node": gap > 1.5 * F.count(F.lit(1)).over(all_) + 10.0, "first": F.row_number().over(group) == 1})
    gain = F.when(F.col("node"), F.log10(F.col("own") / F.col("less")) - F.log10("back")).otherwise(0.0)
    return rows.select("key", "suffix", "n", F.when(F.col("node"), F.col("own")).otherwise(F.col("less")).alias("prob"), "prefix", "of", "node", "first", gain.alias("gain"), F.log10("back").alias("log_back"))


def grow(training: DataFrame, words: DataFrame, least: int, max_depth: int, discount: float) -> DataFrame:
    """The tree as a table: key, n, value of n-grams whose occurrences change a score.

    ``words``: (key, n, prob) of the tokens that occur ``least`` times.
    """
    spark = training.sparkSession
    above = words.withColumn("suffix", F.col("key"))
    levels = []
    for depth in range(1, max_depth + 1):
        n = above.count()
        if not n:
            break
        known = spark.sparkContext.broadcast(_filter(above, n))

        def of(hashes, sizes, known=known, depth=depth):
            shorter = keys(hashes, sizes, depth)[-1]
            place = _places(sizes)
            may = _may(known.value, shorter) & (place >= depth - 1)
            # a prefix and a suffix occur as often at least, so both must be known
            at = np.flatnonzero(may[1:] & may[:-1] & (place[1:] >= depth)) + 1
            return shorter[at - 1], hashes[at]

        counted = materialize(_counts(training, of, "prefix", "word").where(F.col("n") >= least), "grams")
        known.destroy()  # the driver's copy too
        levels.append(materialize(_level(counted, above, depth, discount), "level"))
        release(counted)
        above = levels[-1]
    values = spark.createDataFrame([], "key long, n long, value double")
    for level in levels:
        nodes = level.where("node")
        values = values.union(nodes.select("key", "n", "gain")).union(nodes.where("first").select("prefix", "of", "log_back"))
    values = values.groupBy("key").agg(F.max("n").alias("n"), F.sum("value").alias("value")).where("value <> 0")
    values = materialize(values, "values")
    release(*levels)
    return values


def lm_score(docs: DataFrame, max_depth: int = 3, least_count: int = 4) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Learns from the rows whose crc32 of doc_id is not 2 modulo 7. Entries of
    the tree occur ``least_count`` times at least.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    training = docs.where(~F.col("held_out")).select("doc_id", "text")
    counts = materialize(_counts(training, lambda hashes, sizes: (hashes,), "key"), "tokens")
    n_all, v_all, ones, twos = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    unseen = max(discount * v_all, 0.5) / max(n_all, 1) if n_all else 1.0
    words = counts.withColumn("prob", (F.col("n") - discount) / float(max(n_all, 1)))
    often = words.where(F.col("n") >= least_count)
    values = grow(training, often, least_count, max_depth, discount)
    head = _frequent(often) & (F.col("n") >= least_count)
    names = _broadcast(words.where(head), "key", "n")
    frequent = _frequent(values)
    grams = _broadcast(values.where(frequent), "key", "value")
    seldom, left = words.where(~head), values.where(~frequent)
    more = left.count() > 0
    filtered = spark.sparkContext.broadcast(_filter(values, values.count()))

    def run(batches):
        word, gram = (Shares([own.value for own in shares]) for shares in (names, grams))
        known = filtered.value
        for part in (part for batch in batches for part in T.parts(batch, most_bytes=PART)):
            get = lambda k: part.column(part.schema.get_field_index(k))  # noqa: E731, B023
            hashes, sizes = tokens(list(T.texts(get("text"))))
            text, place = np.repeat(np.arange(len(sizes)), sizes), _places(sizes)
            hit, ns = word.find(hashes)
            seen = np.flatnonzero(hit)
            score = np.bincount(text[seen], np.log10((ns - discount) / max(n_all, 1)), len(sizes))
            asked = [(hashes[~hit], text[~hit], np.ones(len(hashes) - len(seen), bool))]
            for k, key in enumerate(keys(hashes, sizes, max_depth + 1)):
                on = np.flatnonzero(_may(known, key) & (place >= k))
                (in_head, changes), which = gram.find(key[on]), text[on]
                score += np.bincount(which[in_head], changes, len(sizes))
                if more:
                    asked.append((key[on[~in_head]], which[~in_head], np.zeros(len(on) - np.count_nonzero(in_head), bool)))
            # tokens and n-grams to be joined: how often in a text
            key, of, token = (np.concatenate(c) for c in zip(*asked, strict=True))
            order = np.lexsort((token, key, of))
            key, of, token = key[order], of[order], token[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]) | (token[1:] != token[:-1]))[: len(key)])
            times = np.diff(np.append(first, len(key)))
            items = pa.StructArray.from_arrays([pa.array(key[first]), pa.array(token[first]), pa.array(times)], ["key", "token", "times"])
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[first], np.arange(len(sizes) + 1)).astype(np.int32)), items)
            logs = np.bincount(text[seen], np.log10(ns + 1.0), len(sizes))
            yield pa.RecordBatch.from_arrays(
                [get("doc_id"), get("held_out"), pa.array(sizes), pa.array(np.bincount(text[seen], minlength=len(sizes))), pa.array(logs), pa.array(score), rare],
                ["doc_id", "held_out", "n_tokens", "known", "logs", "partial", "rare"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, known long, logs double, partial double, rare array<struct<key: long, token: boolean, times: long>>"
    scored = materialize(docs.mapInArrow(run, schema).withColumn("row_id", F.monotonically_increasing_id()), "scored")
    for share in (*names, *grams, filtered):  # or they would stay in executors and driver
        share.destroy()
    table = seldom.select("key", F.lit(True).alias("token"), F.log10(F.col("n") + 1.0).alias("log"), F.log10("prob").alias("value"))
    if more:
        table = table.union(left.select("key", F.lit(False), F.lit(0.0), "value"))
    found = (
        scored.select("row_id", F.inline("rare"))
        .join(table, ["key", "token"])
        .groupBy("row_id")
        .agg(F.sum(F.when(F.col("token"), F.col("times"))).alias("more"), F.sum(F.col("log") * F.col("times")).alias("more_logs"), F.sum(F.col("value") * F.col("times")).alias("more_score"))
    )
    known = F.col("known") + F.coalesce("more", F.lit(0))
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n_all + v_all + 1)))
    score = F.col("partial") + F.coalesce("more_score", F.lit(0.0)) + (F.col("n_tokens") - known) * F.log10(F.lit(float(unseen)))
    return (
        scored.drop("rare")
        .join(found, "row_id", "left")
        .select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
    )
