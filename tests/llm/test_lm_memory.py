"""What op4 holds in a Python worker has a bound, and its broadcasts go with the query."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa

from corvid.llm import lm_scoring
from tests.llm.test_llm import corpus, frame


def test_counting_holds_little():
    words = np.random.default_rng(4).integers(0, 5000, (700, 2000))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(700)), "text": [" ".join(f"w{x}" for x in row) for row in words]})
    count = lm_scoring._counting(lambda hashes, sizes: (hashes[:-1], hashes[1:]), ["prefix", "word"])
    rows = total = 0
    tracemalloc.start()
    for got in count(iter([batch])):
        rows, total = max(rows, got.num_rows), total + int(np.sum(got.column(2).to_numpy()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 700 * 2000 <= total < 700 * 2001
    assert rows <= 1 << 16 and peak < 80e6


def test_shares_in_order():
    keys = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 1 << 17)
    counts = np.arange(len(keys)) + 4
    found = lm_scoring.Shares([lm_scoring._packed(keys, counts)])
    index, values = found.indexes[0], found.values[0]
    assert index.place is None and index.keys.nbytes + index.start.nbytes + values.nbytes <= 20 * len(keys) + 4
    hit, got = found.find(np.append(keys, 7))
    assert hit[:-1].all() and not hit[-1] and np.array_equal(got, counts)


def test_broadcasts_go(spark, monkeypatch):
    made = []
    plain = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (made.append(found := plain(self, value)), found)[1])
    rows = frame(spark, corpus())
    assert lm_scoring.lm_score(rows, least_count=3).count() == rows.count()
    assert len(made) > 3 and not [b for b in made if os.path.exists(b._path)]
