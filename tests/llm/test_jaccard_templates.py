"""Texts of one template that stay below the threshold: what is compared grows with the rows, not with their square."""

import random

import pytest
from pyspark.sql import functions as F

from corvid.llm import ngram_jaccard as J


def texts(n, shared, seed):
    """Texts of 200 words, of which the first ``shared`` are the same in each."""
    rnd = random.Random(seed)
    template = [f"t{i}" for i in range(200)]
    return [(i, " ".join(template[:shared] + [f"u{rnd.randrange(10**9)}" for _ in range(200 - shared)])) for i in range(n)]


@pytest.mark.parametrize("shared", [176, 182])
def test_templates_below_the_threshold(spark, monkeypatch, shared):
    compared = []
    keep = J.materialize

    def seen(df, tag):
        out = keep(df, tag)
        if tag == "index":
            one, two = J._sides(out, 85)
            compared.append(one.select("gram").join(two.select("gram"), "gram").count())
        return out

    monkeypatch.setattr(J, "materialize", seen)
    rows = texts(400, shared, 1) + [(900, " ".join(f"t{i}" for i in range(150)))]  # one shorter row, near to none
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got)
    assert compared and max(compared) <= 1.2 * len(rows)


def test_sizes_apart(spark):
    """The smaller row of a pair is found from either side: sizes from 85 to 100 of a hundred link, less does not."""
    words = [f"w{i}" for i in range(203)]
    rows = [(1, " ".join(words))] + [(2 + k, " ".join(words[: 203 - 3 * k])) for k in range(1, 16)]
    sets = {d: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for d, t in rows}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where(F.col("doc_id").isNotNull()).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: top(d) for d in sets}
