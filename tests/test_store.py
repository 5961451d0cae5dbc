"""The store: versions, two writers, positions, filters down to the scan."""

import threading

import pytest
from pyspark.sql import functions as F

from corvid.operators import filters
from corvid.sources import _fs
from corvid.sources.store import SUMMARY, Store


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def numbers(spark, lo, hi):
    return spark.range(lo, hi).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))


def test_versions(spark, tmp_path):
    held = Store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        held.read()
    held.add(numbers(spark, 0, 10))
    held.add(numbers(spark, 10, 20))
    held.delete(spark.createDataFrame([(3,), (15,), (99,)], ["id"]))
    held.update(spark.createDataFrame([(4, "new"), (77, "none")], ["id", "text"]))
    assert held.version() == 4 and ids(held.read()) == [i for i in range(20) if i not in (3, 15)]
    assert held.read().where("id = 4").first().text == "new"
    assert held.peek()[0] == 18 and [r.id for r in held.peek()[1].collect()] == [0, 1, 2, 4, 5]
    # old versions stay
    assert ids(held.read(1)) == list(range(10)) and ids(held.read(2)) == list(range(20))
    assert held.read(3).where("id = 4").first().text == "t4"
    with pytest.raises(ValueError):
        held.read(9)
    held.delete(spark.createDataFrame([(99,)], ["id"]))  # no rows, no version
    assert held.version() == 4
    before = sorted(map(tuple, held.read().collect()))
    held.compact()
    state = held.snapshot()
    assert sorted(map(tuple, held.read().collect())) == before and not state.deletes and len(state.files) == 1
    assert ids(held.read(3)) == ids(held.read(5))
    with pytest.raises(ValueError):
        held.add(spark.createDataFrame([(1, 2)], ["id", "other"]))


def test_appending_writes_only_what_is_appended(spark, tmp_path):
    held = Store(spark, str(tmp_path / "s"))
    held.add(numbers(spark, 0, 50_000))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "s" / "data").rglob("*.parquet")}
    held.add(numbers(spark, 50_000, 50_010).coalesce(1))
    new = [p for p in (tmp_path / "s" / "data").rglob("*.parquet") if p not in before]
    assert len(new) == 1 and new[0].stat().st_size < 2000 and all(p.stat().st_mtime_ns == t for p, t in before.items())


def test_log_is_summed_up(spark, tmp_path):
    held = Store(spark, str(tmp_path / "s"))
    for i in range(SUMMARY + 2):
        held.add(numbers(spark, i, i + 1).coalesce(1))
    assert [n for n in held._logged() if n.endswith(".sum")] == [f"{SUMMARY:020d}.sum"]
    for i in range(1, SUMMARY):
        (tmp_path / "s" / "log" / f"{i:020d}.json").unlink()  # not needed any more
    assert ids(held.read()) == list(range(SUMMARY + 2)) and ids(held.read(SUMMARY)) == list(range(SUMMARY))


def test_two_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "s")
    Store(spark, path).add(numbers(spark, 0, 5))
    errors = []

    def write(k):
        try:
            for j in range(4):
                Store(spark, path).add(numbers(spark, 100 * k + j, 100 * k + j + 1).coalesce(1))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    held = Store(spark, path)
    assert held.version() == 13 and ids(held.read()) == [*range(5), *[100 * k + j for k in (1, 2, 3) for j in range(4)]]


def test_conflicting_changes_start_anew(spark, tmp_path):
    """Another writer deletes a row of the same file between reading and committing."""
    held = Store(spark, str(tmp_path / "s"))
    held.add(numbers(spark, 0, 10).coalesce(1))
    stale = held.snapshot()
    file = next(iter(stale.files))
    Store(spark, held.path).delete(spark.createDataFrame([(1,)], ["id"]))
    assert not held._commit(stale, {"delete": {"path": "deletes/x", "files": {file: 1}}}, {file})
    assert held._commit(stale, {"add": []}, set())  # an append goes on to the next number
    tries = []

    class Racing(Store):
        def _commit(self, base, entry, reads=frozenset()):
            if not tries:
                tries.append(1)
                Store(spark, self.path).update(spark.createDataFrame([(5, "other")], ["id", "text"]))
            return super()._commit(base, entry, reads)

    Racing(spark, held.path).update(spark.createDataFrame([(5, "mine"), (6, "mine")], ["id", "text"]))
    assert sorted(map(tuple, held.read().where("id in (5, 6)").collect())) == [(5, "mine"), (6, "mine")]
    assert ids(held.read()) == [i for i in range(10) if i != 1]


def test_batches_are_written_once(spark, tmp_path):
    held = Store(spark, str(tmp_path / "s"))
    for batch in (0, 1, 1, 0, 2):
        held.add(numbers(spark, batch, batch + 1), batch=("stream", batch))
    assert ids(held.read()) == [0, 1, 2]


def test_names_are_given_once(spark, tmp_path):
    path = str(tmp_path / "log" / "1.json")
    won = []
    threads = [threading.Thread(target=lambda k=k: _fs.put_new(spark, path, f"writer {k}") and won.append(k)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and _fs.read(spark, path) == f"writer {won[0]}" and _fs.names(spark, str(tmp_path / "log")) == ["1.json"]


# --- filters ---

ROWS = [
    (1, {"source": "a.pdf", "page": "1", "draft": "true"}),
    (2, {"source": "a.pdf", "page": "7"}),
    (3, {"source": "b.txt", "page": "12", "lang": "de"}),
    (4, {"source": "c.md"}),
    (5, {}),
    (6, None),
]
QUERIES = [
    {},
    {"source": "a.pdf"},
    {"source": "a.pdf", "page": 7},
    {"page": {"$gt": 1, "$lte": 12}},
    {"page": {"$ne": 7}},
    {"page": {"$nin": [1, 12]}},
    {"source": {"$in": ["b.txt", "c.md", "d"]}},
    {"$or": [{"lang": "de"}, {"page": {"$lt": 2}}]},
    {"$and": [{"$or": [{"source": "a.pdf"}, {"source": "b.txt"}]}, {"page": {"$gte": 7}}]},
    {"$not": {"page": {"$gt": 5}}},
    {"$not": {"$or": [{"source": "a.pdf"}, {"page": {"$gte": 12}}]}},
    {"lang": {"$exists": True}},
    {"$not": {"page": {"$exists": True}}},
    {"draft": True},
    {"source": {"$in": []}},
    {"source": {"$nin": []}},
]


def brute(query, meta):
    """The meaning of a filter, without negation being moved."""
    meta = meta or {}

    def test(key, op, value):
        own = meta.get(key)
        if own is not None and not isinstance(value, str) and op != "$exists":
            kind = value[0] if isinstance(value, list) and value else value
            own = own == "true" if isinstance(kind, bool) else own if isinstance(kind, (str, list)) else float(own)
        if op == "$exists":
            return (own is not None) == value
        if own is None:
            return op in ("$ne", "$nin")
        return {"$eq": lambda: own == value, "$ne": lambda: own != value, "$gt": lambda: own > value, "$gte": lambda: own >= value, "$lt": lambda: own < value, "$lte": lambda: own <= value, "$in": lambda: own in value, "$nin": lambda: own not in value}[op]()

    out = []
    for key, value in query.items():
        if key == "$and":
            out.append(all(brute(v, meta) for v in value))
        elif key == "$or":
            out.append(any(brute(v, meta) for v in value))
        elif key == "$not":
            out.append(not brute(value, meta))
        else:
            out += [test(key, op, v) for op, v in (value if isinstance(value, dict) else {"$eq": value}).items()]
    return all(out)


@pytest.mark.parametrize("promoted", [{}, {"source": "string", "page": "long"}])
def test_filters(spark, tmp_path, promoted):
    held = Store(spark, str(tmp_path / "s"), promoted)
    for row in ROWS:  # a file for each row, so that files are ruled out too
        held.add(spark.createDataFrame([row], "id long, metadata map<string,string>").coalesce(1))
    for query in QUERIES:
        assert ids(held.read(where=query)) == [i for i, m in ROWS if brute(query, m)], query
    assert held.read().columns == ["id", "metadata"]
    if promoted:
        assert len(held.files({"page": {"$gt": 5}})) == 2 and len(held.files({"source": "b.txt", "page": 12})) == 1
        assert len(held.files({"source": {"$ne": "a.pdf"}})) == 4 and len(held.files()) == 6
        plan = held.read(where={"source": "a.pdf", "page": {"$gte": 1}})._jdf.queryExecution().toString()
        pushed = plan[plan.rindex("PushedFilters") :][:300]
        assert "EqualTo(meta_source,a.pdf)" in pushed and "GreaterThanOrEqual(met" in pushed and "_metadata" not in pushed
    held.delete(where={"source": "a.pdf"})
    assert ids(held.read()) == [3, 4, 5, 6]


@pytest.mark.parametrize("bad", [{"$nor": []}, {"a": {"$like": 1}}, {"$and": []}, {"$or": {"a": 1}}, {"a": {"$in": 3}}])
def test_unknown_filters(bad):
    with pytest.raises(ValueError):
        filters.normal(bad)


def test_search_with_filters(spark, tmp_path):
    held = Store(spark, str(tmp_path / "s"), {"kind": "string"})
    rows = [(i, [float(i), 0.0], {"kind": "even" if i % 2 == 0 else "odd"}) for i in range(20)]
    held.add(spark.createDataFrame(rows, "id long, vector array<double>, metadata map<string,string>"))
    held.delete(spark.createDataFrame([(2,)], ["id"]))
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, vector array<double>")
    before = held.search(q, 3, {"kind": "even"}).orderBy("rank").collect()
    assert [(r.id, r.rank, r.metadata["kind"]) for r in before] == [(0, 1, "even"), (4, 2, "even"), (6, 3, "even")]
    after = held.search(q, 3, {"kind": "even"}, before=False).collect()
    assert [(r.id, r.rank) for r in after] == [(0, 1)]
