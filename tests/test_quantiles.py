"""Percentiles by refinement against those of sorted values."""

import random

import numpy as np
import pytest

from corvid.operators.quantiles import quantiles


def test_against_sorted_values(spark):
    rnd = random.Random(8)
    groups = {
        ("a", 1): [rnd.gauss(0, 1) for _ in range(5000)],
        ("b", 1): [rnd.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(700)],
        ("c", 2): [10.0 ** (60 * k) for k in range(-5, 6)],  # far apart
        ("d", 2): [3.25],
        (None, 2): [float(i) for i in range(10)],
        ("e", 3): [-1.5, -1.5],
        ("f", 3): [float("-inf"), -1.0, 0.0, 2.0, float("inf")],
    }
    rows = [(g, h, v) for (g, h), vs in groups.items() for v in vs] + [("a", 1, None), ("a", 1, float("nan")), ("nothing", 1, None)]
    rnd.shuffle(rows)
    at = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p95": 0.95, "high": 1.0}
    got = quantiles(spark.createDataFrame(rows, "g string, h long, v double").repartition(5), "v", ["g", "h"], at).collect()
    assert len(got) == len(groups)
    for r in got:
        own = sorted(groups[r.g, r.h])
        assert r.n == len(own)
        for name, q in at.items():
            p = q * (len(own) - 1)
            a, b = own[int(np.floor(p))], own[int(np.ceil(p))]
            want = a if a == b else a * (1 - (p - np.floor(p))) + b * (p - np.floor(p))
            assert r[name] == want or abs(r[name] - want) <= 1e-12 * abs(want), (r.g, name)


def test_odd_calls(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert quantiles(empty, "v", ["g"], {"p": 0.5}).count() == 0
    with pytest.raises(ValueError):
        quantiles(empty, "v", ["g"], {"p": 1.5})
    with pytest.raises(ValueError):
        quantiles(empty, "v", ["g"], {})
