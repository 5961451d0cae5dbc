"""An inverted file of vectors, written once and searched often.

Vectors are dealt to cells, by the nearest of some centroids, and written by cell
(a Parquet partition), sorted by id, with a product code of dim / 4 bytes
beside each vector. Search ranks the cells for each question, reads the codes of the
nearest cells only (partition pruning, one narrow column), keeps a shortlist by
distances to the codes, and reads the full vectors of the shortlist alone for exact
scores.

Centroids, code books and the number of cells to look into are fitted on a bounded sample: the
``most_rows`` vectors whose ids have the least hashes, of ``SAMPLE_BYTES`` at most.
Every vector is indexed. How many cells are needed for a recall of ``recall`` is
measured on that sample, and depends on the vectors: where there are
clusters a few cells do, where there are none many are needed, and the codes are what
keeps the reading small. Shortlists hold ``SHORT`` rows, but ``SHARE`` of the
corpus at most.

Null vectors and null ids are not indexed. Rows of equal id are rows of their own.
Questions are the stated query set, in blocks of bounded size; of several questions
of one query_id the least vector counts, and those without an id or a vector match
nothing. An empty corpus gives an empty index and no hits.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.vector import squared_l2
from .search import _blocks, best, distinct_questions, first_k, spans, top_k

SAMPLE_BYTES = 64 << 20
MOST_CELLS = 4096
SHORT, SHARE = 100, 0.04
_WIDTH = 4  # dimensions of a part of the code
_ROW = "id long, code binary, vector array<float>, cell int"


@dataclasses.dataclass
class Model:
    """Centroids of the cells, code books of the parts, cells to look into for the recall aimed at, rows indexed when fitted."""

    centroids: np.ndarray
    books: list[np.ndarray]
    probes: int
    rows: int

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return _nearest(vectors, self.centroids)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        parts = [_nearest(vectors[:, j * _WIDTH : (j + 1) * _WIDTH], book) for j, book in enumerate(self.books)]
        return np.stack(parts, axis=1).astype(np.uint8)

    def tables(self, questions: np.ndarray) -> list[np.ndarray]:
        """Of each part: squared distances of the questions' parts to its book."""
        return [((questions[:, None, j * _WIDTH : (j + 1) * _WIDTH] - book[None]) ** 2).sum(2) for j, book in enumerate(self.books)]

    def ranked_cells(self, questions: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each question."""
        far = (self.centroids**2).sum(1)[None, :] - 2 * questions @ self.centroids.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    out = np.empty(len(vectors), np.int64)
    for lo, hi in spans(len(vectors), len(centroids)):
        out[lo:hi] = np.argmax(vectors[lo:hi] @ centroids.T - half, axis=1)
    return out


def _means(vectors: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    out = vectors[np.sort(rng.choice(len(vectors), min(k, len(vectors)), replace=False))].copy()
    for _ in range(rounds):
        own = _nearest(vectors, out)
        n = np.bincount(own, minlength=len(out))
        sums = np.stack([np.bincount(own, vectors[:, d], len(out)) for d in range(vectors.shape[1])], axis=1)
        out = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], out)
    return out


def _vectors(corpus: DataFrame) -> DataFrame:
    return corpus.where("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def fit(corpus: DataFrame, cells: int | None = None, recall: float = 0.99, most_rows: int = 20_000, seed: int = 42) -> Model:
    """A model of ``corpus (id, vector)`` from a bounded sample."""
    corpus = _vectors(corpus)
    rows, dim = corpus.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    most = max(256, min(most_rows, SAMPLE_BYTES // (8 * dim)))
    sample = corpus.orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toPandas()["vector"]
    sample = np.array(sample.tolist(), np.float64).reshape(-1, dim) if len(sample) else np.zeros((1, dim))
    cells = min(cells or max(1, round(rows**0.5)), MOST_CELLS, len(sample))
    model = Model(_means(sample, cells, seed), [_means(sample[:, j : j + _WIDTH], 256, seed) for j in range(0, dim, _WIDTH)], cells, rows)
    # the cells of the nearest rows of some of the sample, by their place among the question's cells
    asked = sample[:: max(1, len(sample) // 200)]
    own = model.cells(sample)
    order = model.ranked_cells(asked, len(model.centroids))
    places = []
    for question, ranked in zip(asked, order, strict=True):
        near = np.argsort(((sample - question) ** 2).sum(1), kind="stable")[1 : 1 + C.TOP_K]
        at = np.empty(len(ranked), np.int64)
        at[ranked] = np.arange(len(ranked))
        places.extend(at[own[near]])
    if places:
        model.probes = int(np.quantile(places, recall, method="higher")) + 1
    return model


class VectorIndex:
    """An index in a folder: ``model`` (one row) and ``rows`` by cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, corpus: DataFrame, **fitting) -> VectorIndex:
        model = fit(corpus, **fitting)
        self._deal(corpus, model)
        self._keep(model)
        return self

    def _keep(self, model: Model) -> None:
        row = (model.centroids.astype(np.float64).tobytes(), [b.astype(np.float64).tobytes() for b in model.books], model.dim, model.probes, model.rows)
        self.spark.createDataFrame([row], "centroids binary, books array<binary>, dim int, probes int, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")

    def model(self) -> Model:
        r = self.spark.read.parquet(f"{self.path}/model").first()
        widths = [min(_WIDTH, r.dim - j) for j in range(0, r.dim, _WIDTH)]
        return Model(np.frombuffer(r.centroids).reshape(-1, r.dim), [np.frombuffer(b).reshape(-1, w) for b, w in zip(r.books, widths, strict=True)], r.probes, r.n)

    def append(self, corpus: DataFrame) -> None:
        """Deal more vectors to the cells there are; only these are written. An index of no vectors is fitted to them."""
        model = self.model()
        if model.rows:
            self._deal(corpus, model)
        else:
            self.build(corpus)

    def _deal(self, corpus: DataFrame, model: Model) -> None:
        shared = self.spark.sparkContext.broadcast(model)

        def encode(batches):
            for batch in batches:
                if batch.num_rows:
                    vectors = _matrix(batch.column(1), batch.num_rows)
                    codes = [x.tobytes() for x in shared.value.codes(vectors)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), batch.column(1), pa.array(shared.value.cells(vectors).astype(np.int32))], ["id", "code", "vector", "cell"])

        rows = _vectors(corpus).mapInArrow(encode, _ROW)
        # by range, so that a large cell is several files
        rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_ROW).parquet(f"{self.path}/rows")

    def shortlisted(self, questions: DataFrame, k: int = C.TOP_K, probes: int | None = None, short: int | None = None) -> DataFrame:
        """query_id, id, cell of the rows whose codes are nearest, those of the nearest cells."""
        model = self.model()
        short = short or max(4 * k, min(SHORT, int(model.rows * SHARE)))
        probes = min(probes or model.probes, len(model.centroids))
        hits = self.spark.createDataFrame([], "query_id long, id long, cell int, score double")
        if not model.rows:
            return hits.select("query_id", "id", "cell")
        for ids, matrix in _blocks(questions, model.dim + 256 * len(model.books)):
            asked = model.ranked_cells(matrix, probes)
            by_cell: dict[int, list[int]] = {}
            for q, own in enumerate(asked):
                for c in own:
                    by_cell.setdefault(int(c), []).append(q)
            shared = self.spark.sparkContext.broadcast((ids, model.tables(matrix), {c: np.array(q) for c, q in by_cell.items()}))
            rows = self.rows() if len(by_cell) == len(model.centroids) else self.rows().where(F.col("cell").isin(sorted(by_cell)))
            hits = hits.union(rows.select("id", "code", "cell").mapInArrow(_near(shared, short), "query_id long, id long, cell int, score double"))
        return best(hits, short, "score").select("query_id", "id", "cell")

    def search(self, questions: DataFrame, k: int = C.TOP_K, probes: int | None = None, short: int | None = None, digits: int = 6) -> DataFrame:
        """query_id, id, score (squared L2), rank of the ``k`` nearest found, for each of ``questions (query_id, vector)``."""
        questions = distinct_questions(questions)
        near = self.shortlisted(questions, k, probes, short).distinct()
        scored = near.join(self.rows().select("cell", "id", "vector"), ["cell", "id"]).join(questions.select("query_id", F.col("vector").alias("_q")), "query_id")
        return best(scored.select("query_id", "id", F.round(squared_l2(F.col("_q"), F.col("vector")), digits).alias("score")), k, "score")

    def measured(self, questions: DataFrame, corpus: DataFrame, k: int = C.TOP_K) -> dict:
        """recall against the exact_hits of exact search, and the shares of the corpus whose codes and whose vectors a question reads."""
        questions = distinct_questions(questions)
        exact = top_k(questions, corpus, k)
        want, found = exact.join(self.search(questions, k).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.count(F.lit(1)), F.count("hit")).first()
        sizes = {r[0]: r[1] for r in self.rows().groupBy("cell").count().collect()}
        model, asked, total = self.model(), questions.count(), max(1, sum(sizes.values()))
        read = sum(sizes.get(int(c), 0) for _, matrix in _blocks(questions, model.dim) for own in model.ranked_cells(matrix, model.probes) for c in own)
        return {"recall": found / max(1, want), "exact_hits": want, "codes": read / max(1, asked) / total, "vectors": self.shortlisted(questions, k).count() / max(1, asked) / total}


def _near(shared, short: int):
    """Each task's best rows of each question, in three small matrices."""

    def run(batches):
        ids, tables, by_cell = shared.value
        far, names, cells = np.full((len(ids), short), np.inf), np.full((len(ids), short), -1, np.int64), np.zeros((len(ids), short), np.int32)
        for batch in batches:
            own_cells = batch.column(2).to_numpy()
            for c in np.unique(own_cells):
                asked = by_cell.get(int(c))
                if asked is None:
                    continue
                part = batch.filter(pa.array(own_cells == c))
                new = part.column(0).to_numpy()
                codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(new), -1)
                for lo, hi in spans(len(asked), len(new)):
                    own = asked[lo:hi]
                    score = np.zeros((len(own), len(new)))
                    for j, table in enumerate(tables):
                        score += table[own][:, codes[:, j]]
                    order = first_k(score, new, short)
                    both, which = np.hstack([far[own], np.take_along_axis(score, order, 1)]), np.hstack([names[own], new[order]])
                    place = np.hstack([cells[own], np.full(order.shape, c, np.int32)])
                    first = np.lexsort((which, both), axis=1)[:, :short]
                    far[own], names[own], cells[own] = (np.take_along_axis(x, first, 1) for x in (both, which, place))
        some = np.isfinite(far)
        columns = [np.repeat(ids, some.sum(1)), names[some], cells[some], far[some]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "id", "cell", "score"])

    return run
