"""The tree of op4 is joined by hash: what the driver takes has a bound, and results don't hang on it."""

from corvid.llm import lm_scoring
from tests.llm.test_llm import corpus, frame


def test_bounded_tables_score_alike(spark, monkeypatch):
    rows = frame(spark, corpus() * 3)
    gathered = []
    plain = type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda self: (gathered.append(found := plain(self)), found)[1])
    most, got = [], []
    for head, bits in ((1 << 20, 1 << 27), (8, 1 << 8)):
        monkeypatch.setattr(lm_scoring, "HEAD", head, raising=False)
        monkeypatch.setattr(lm_scoring, "BITS", bits, raising=False)
        gathered.clear()
        got.append(sorted(lm_scoring.lm_score(rows, least_count=3).collect()))
        most.append(max(t.num_rows for t in gathered))
    assert most[0] > 100 and most[1] <= 8
    for a, b in zip(*got, strict=True):
        assert a[:5] == b[:5] and abs(a.base_score - b.base_score) < 1e-6 and abs(a.score - b.score) < 1e-6
