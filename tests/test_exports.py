"""Exports, result folders, prompts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvid.functions.vector import dense_score
from corvid.operators import rewrite
from corvid.sources import exports


def test_human_evaluations(spark, tmp_path):
    rows = spark.createDataFrame([(1, 4.0, None), (2, 3.0, "fine")], "item_id long, overall double, comments string")
    done = exports.human_evaluations(rows, str(tmp_path), at=datetime(2025, 12, 31, 23, 59, 1))
    assert done == {"status": "exported", "format": "json", "filename": f"{tmp_path}/human_eval_results_20251231_235901.json", "count": 2}
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(done["filename"]).collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError, match="Unsupported format: csv"):
        exports.human_evaluations(rows, str(tmp_path), "csv")
    assert exports.human_evaluations(rows.limit(0), str(tmp_path / "empty"))["count"] == 0


def test_benchmark_results(spark, tmp_path):
    schema = "dataset string, n long"
    assert exports.benchmark_results(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "a.json").write_text('{\n  "dataset": "squad",\n  "n": 3\n}')
    (tmp_path / "b.json").write_text("[broken")
    (tmp_path / "c.txt").write_text("{}")
    got = {r.path.rpartition("/")[2]: (r.dataset, r.n) for r in exports.benchmark_results(spark, str(tmp_path), schema).collect()}
    assert got == {"a.json": ("squad", 3), "b.json": (None, None)}


def test_prompts_and_scores(spark):
    rows = spark.createDataFrame([("x = 1", None, 0.25), ("x = 1", "", None), ("x = 1", "E", 1.5), (None, "E", 0.0)], "code string, error string, distance double")
    got = rows.select(rewrite.explain_prompt(F.col("code")), rewrite.debug_prompt(F.col("code"), F.col("error")), dense_score(F.col("distance"))).collect()
    assert [r[2] for r in got] == [0.75, 0.0, -0.5, 1.0]
    assert got[0][0] == "Please explain this code:\n\nx = 1" and got[0][1] == got[1][1] == "Can you help me debug this code?\n\nx = 1"
    assert got[2][1] == "I'm getting this error in my code:\n\nx = 1\n\nError: E\n\nHow can I fix this?" and got[3][:2] == (None, None)
