"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models; each
model also reads the probabilities of all categories before it. While training,
those are out-of-fold predictions, so that later models see them as they will be
at scoring time and not as fitted on their own rows. A fold's model is made
without its rows in every part: words are selected, style is scaled and weights
are fitted on the other folds.

Features are the presence of words (A-Z lower-cased, ASCII punctuation off) and
of word beginnings, which stand for inflected forms, that tell the category's
rows from others by a likelihood ratio test, and six ratios of style. Models are fitted on a sample of labelled
rows of bounded size: ``most_rows``, chosen by a hash of doc_id. What reaches
the driver is bounded by it and by ``most_words`` for a category. All rows of the
documents are scored, whole texts each.

Null texts are empty texts. Rows whose label is null teach that category
nothing. Repeated label rows of a document count by their largest label;
repeated document rows are scored as often as given and teach as often. Words of
equal gain are taken by their hash; a text is flagged if its probability is at the limit or above. If a
category has less than ``least_rows`` rows of either kind, its model is the
category's constant share. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T

_TRIM = np.arange(256, dtype=np.uint8)
_TRIM[65:91] = np.arange(97, 123)
_TRIM[[b for b in range(128) if not chr(b).isalnum()]] = 32
_N_STYLE = 6

#: The chain over the labels at hand: (category, its 0/1 label as SQL).
CATEGORIES = (("low_quality", "1 - quality"), ("toxic", "toxic"))


def words(data: np.ndarray) -> np.ndarray:
    """Distinct hashes of a text's words and of their first four to six bytes, sorted."""
    folded = _TRIM[data]
    starts, ends = T.word_bounds(folded)
    cut = [np.minimum(ends, starts + k) for k in (4, 5, 6)]
    ends = np.concatenate([ends, *cut])
    return np.unique(T.to_signed(T.word_hashes(folded, np.tile(starts, 4), ends)))


def style(data: np.ndarray) -> list[float]:
    """Six ratios: capitals, symbols, digits, bars, repeated lines, words of one kind."""
    n = max(len(data), 1)
    starts, ends = T.word_bounds(data)
    plain = T.word_hashes(data, starts, ends)
    lines = [x for x in data.tobytes().split(b"\n") if x.strip()]
    count = np.bincount(data, minlength=256)
    return [
        float(count[65:91].sum()) / n,
        float(count[[33, 35, 36, 37, 38, 42]].sum()) / n,
        float(count[48:58].sum()) / n,
        float(count[124]) / max(len(starts), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        len(np.unique(plain)) / max(len(plain), 1),
    ]


@dataclass
class Chain:
    """Categories in order, the words' sorted hashes, and a weight vector for each category."""

    names: list[str]
    keys: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    limits: list[float]

    def features(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.keys) + _N_STYLE)
        if len(self.keys):
            own = words(data)
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            out[at[self.keys[at] == own]] = 1.0
        out[len(self.keys) :] = (np.array(style(data)) - self.mean) / self.scale
        return out

    def probabilities(self, x: np.ndarray) -> list[float]:
        out: list[float] = []
        for w in self.weights:
            out.append(float(_share(w[0] + x @ w[1 : len(x) + 1] + np.dot(w[len(x) + 1 :], out))))
        return out


def _share(odds):
    """The probability of log odds."""
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Weights (the constant first) by Newton's method with a ridge on all but the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _folds(doc_ids: np.ndarray, n_folds: int) -> np.ndarray:
    return (T.mix(doc_ids.astype(np.int64).view(np.uint64)) % T.U64(n_folds)).astype(np.int64)


def _limit(odds: np.ndarray, y: np.ndarray) -> float:
    """The probability from which a row is flagged: best F1 out of fold, in the middle of its gap."""
    order = np.argsort(-odds)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(len(y)) + 1 + y.sum())
    best = int(f1.argmax())
    low = odds[order[best + 1]] if best + 1 < len(odds) else odds[order[best]] - 2
    return float(1 / (1 + np.exp(-(odds[order[best]] + low) / 2)))


def _sampled(docs: DataFrame, labels: DataFrame, categories: tuple, most_rows: int) -> DataFrame:
    """Text and labels of at most about ``most_rows`` labelled documents."""
    columns = [F.max(F.expr(sql).cast("int")).alias(f"y{k}") for k, (_, sql) in enumerate(categories)]
    labels = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*columns)
    total = labels.count()
    share = min(1.0, 0.95 * most_rows / max(total, 1))
    sample = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id")  # bounded by most_rows


def _told_apart(n: Column, hits: Column, rows: int, ones: int) -> Column:
    """G of a word's two-by-two table."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    p = ones / rows
    rest, without = n - hits, F.lit(float(rows)) - n
    return 2 * (
        part(hits, n * p)
        + part(rest, n * (1 - p))
        + part(F.lit(float(ones)) - hits, without * p)
        + part(F.lit(float(rows - ones)) - rest, without * (1 - p))
    )


def fit(docs: DataFrame, labels: DataFrame, categories: tuple = CATEGORIES, most_rows: int = 12_000, most_words: int = 200, least_gain: float = 30.0, least_rows: int = 10, n_folds: int = 5) -> Chain:
    """Fit the chain on a sample of the labelled documents."""
    names, n_y = [c for c, _ in categories], len(categories)
    sample = _sampled(docs, labels, categories, most_rows)

    def spread(batches):
        for batch in batches:
            get = lambda k: batch.column(batch.schema.get_field_index(k))  # noqa: E731, B023
            own = [words(d) for d in T.texts(get("text"))]
            sizes = [len(w) for w in own]
            columns = [np.repeat(c, sizes).astype(np.int32) for c in (_folds(get("doc_id").to_numpy(), n_folds), *(get(f"y{k}").fill_null(-1).to_numpy(zero_copy_only=False) for k in range(n_y)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *own])), *map(pa.array, columns)], ["key", "fold", *(f"y{k}" for k in range(n_y))])

    ys = ", ".join(f"y{k} int" for k in range(n_y))
    given = sample.select("doc_id", *(f"y{k}" for k in range(n_y))).toPandas()
    rows_fold = _folds(given["doc_id"].to_numpy(), n_folds)
    # the words of each variant: all rows (-1), or all but those of a fold
    counts = [
        F.count_if((F.col("fold") == f) & (F.col(f"y{k}") >= low)).alias(f"{name}{k}_{f}")
        for k in range(n_y) for f in range(n_folds) for name, low in (("n", 0), ("h", 1))
    ]
    per_word = sample.mapInArrow(spread, f"key long, fold int, {ys}").groupBy("key").agg(*counts)
    gains = []
    for v in range(-1, n_folds):
        among = [f for f in range(n_folds) if f != v]
        for k in range(n_y):
            y = given[f"y{k}"].astype("float64").to_numpy()[np.isin(rows_fold, among)]
            zeros, ones = int((y == 0).sum()), int((y == 1).sum())
            if min(zeros, ones) >= least_rows:
                n, hits = (sum((F.col(f"{name}{k}_{f}") for f in among), F.lit(0)).cast("double") for name in "nh")
                gains.append(F.struct(F.lit(v).alias("variant"), F.lit(k).alias("category"), F.when(n >= 5, _told_apart(n, hits, zeros + ones, ones)).alias("gain")))
    chosen: dict[int, set[int]] = {v: set() for v in range(-1, n_folds)}
    if gains:
        best = per_word.select("key", F.explode(F.array(*gains)).alias("g")).select("key", "g.*").where(F.col("gain") >= least_gain)
        place = F.row_number().over(Window.partitionBy("variant", "category").orderBy(F.desc("gain"), "key"))
        for row in best.withColumn("place", place).where(F.col("place") <= most_words).select("variant", "key").collect():
            chosen[row["variant"]].add(row["key"])
    every = np.array(sorted(set().union(*chosen.values())), np.int64)
    raw = Chain(names, every, np.zeros(_N_STYLE), np.ones(_N_STYLE), [], [])

    def measured(batches):
        for batch in batches:
            get = lambda k: batch.column(batch.schema.get_field_index(k))  # noqa: E731, B023
            x = [raw.features(d) for d in T.texts(get("text"))]
            on = [np.flatnonzero(v[: len(every)]).tolist() for v in x]
            yield pa.RecordBatch.from_arrays(
                [get("doc_id"), pa.array(on, pa.list_(pa.int32())), pa.array([v[len(every) :].tolist() for v in x], pa.list_(pa.float64())), *(get(f"y{k}") for k in range(n_y))],
                ["doc_id", "on", "style", *(f"y{k}" for k in range(n_y))],
            )

    found = sample.mapInArrow(measured, f"doc_id long, on array<int>, style array<double>, {ys}").toPandas().sort_values("doc_id", ignore_index=True)
    has = np.zeros((len(found), len(every)))
    for i, on in enumerate(found["on"]):
        has[i, np.asarray(on, np.int64)] = 1.0
    ratios = np.array(found["style"].tolist()).reshape(-1, _N_STYLE)
    folds = _folds(found["doc_id"].to_numpy(), n_folds)

    def features_of(v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A variant's features of all rows, and its mean and scale of style."""
        own, on = np.isin(every, list(chosen[v])), folds != v
        mean, scale = (ratios[on].mean(0), np.maximum(ratios[on].std(0), 1e-6)) if on.any() else (raw.mean, raw.scale)
        return np.hstack([has[:, own], (ratios - mean) / scale]), mean, scale

    final, mean, scale = features_of(-1)
    before = np.zeros((len(found), 0))  # probabilities of the categories so far
    weights, limits = [], []
    for k in range(n_y):
        y = found[f"y{k}"].astype("float64").to_numpy()
        known = ~np.isnan(y)
        ones = int((y[known] == 1).sum())
        x = np.hstack([final, before])
        if min(ones, int(known.sum()) - ones) < least_rows:
            share = (ones + 0.5) / (known.sum() + 2)
            weights.append(np.append(np.log(share / (1 - share)), np.zeros(x.shape[1])))
            limits.append(0.5)
            odds = np.full(len(x), weights[-1][0])
        else:
            weights.append(logistic(x[known], y[known]))
            odds = weights[-1][0] + x @ weights[-1][1:]
            for v in range(n_folds):
                out = folds == v
                if out.any() and (known & ~out).any():
                    x = np.hstack([features_of(v)[0], before])
                    w = logistic(x[known & ~out], y[known & ~out])
                    odds[out] = w[0] + x[out] @ w[1:]
            odds = np.clip(odds, -30, 30)
            limits.append(_limit(odds[known], y[known]))
        before = np.hstack([before, _share(odds)[:, None]])
    return Chain(names, np.array(sorted(chosen[-1]), np.int64), mean, scale, weights, limits)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> for each category, and the last category's verdict under its name."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = chain.names

    def run(batches):
        model = shared.value
        for ids, datas in T.each(batches):
            p = [model.probabilities(model.features(d)) for d in datas]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array([q[k] for q in p], pa.float64()) for k in range(len(names))), pa.array([q[-1] >= model.limits[-1] for q in p], pa.bool_())],
                ["doc_id", *(f"p_{n}" for n in names), names[-1]],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(run, f"doc_id long, {', '.join(f'p_{n} double' for n in names)}, {names[-1]} boolean")
