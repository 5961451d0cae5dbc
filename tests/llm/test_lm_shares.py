"""The driver takes the tables of op4 in shares, and results don't hang on their number."""

from corvid.llm import lm_scoring
from tests.llm.test_llm import corpus, frame


def test_shares_score_alike(spark, monkeypatch):
    rows = frame(spark, corpus() * 3)
    gathered = []
    plain = type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda self: (gathered.append(found := plain(self)), found)[1])
    got, most = [], []
    for share in (1 << 19, 64):
        monkeypatch.setattr(lm_scoring, "SHARE", share, raising=False)
        gathered.clear()
        got.append(sorted(lm_scoring.lm_score(rows, least_count=3).collect()))
        most.append(max(t.num_rows for t in gathered if "at" not in t.column_names))
    assert most[0] > 200 and most[1] <= 128
    assert [r[:5] for r in got[0]] == [r[:5] for r in got[1]]
    for a, b in zip(*got, strict=True):
        assert abs(a.base_score - b.base_score) < 1e-9 and abs(a.score - b.score) < 1e-9
