"""A store of rows as a log of files.

Data are Parquet files that are never changed. A log has one small JSON file for
each version, which says what it adds (files, with their rows and the least and
greatest values of their columns), takes out, and which rows of which files are
deleted (files of positions). A version comes to be when its log file gets its
name, which one writer alone can give: of two writers the second finds the name taken,
looks at what was written meanwhile, and takes the next number, or starts anew if files
that it had read were changed. So appending costs what is appended, nothing that was
committed is lost, and a job that fails leaves files that no version names.

Reading a version lists its files from the log (a summary every ``SUMMARY``
versions shortens that), leaves out those whose values rule a filter out, and takes
deleted positions from the files that have some. The log is the driver's, with a few
hundred bytes for each file; rows, keys and positions are not.

``metadata`` may be a map column. Keys that are declared as ``promoted`` are also
written as typed columns, so filters on them reach the Parquet scan and the values of
files; others are looked up in the map. Filters are those of ``operators.filters``.
"""

from __future__ import annotations

import dataclasses
import functools
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..operators import filters, search
from . import _fs


def appended(path: str, rows: DataFrame, vectors: DataFrame | None = None, key: str = "id") -> None:
    """Append rows (with the vectors of the same key); rows without a vector raise ``ValueError``."""
    if vectors is not None:
        if not rows.join(vectors, key, "left_anti").isEmpty():
            raise ValueError("each row needs a vector")
        rows = rows.join(vectors, key)
    rows.write.mode("append").parquet(path)


def upserted(store: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The store with the changes' values where they are not null; unknown keys are left out."""
    fresh = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    both = store.join(fresh, key, "left")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in both.columns else F.col(c) for c in store.columns])


def deleted(store: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


#: Versions after which the log is summed up.
SUMMARY = 20
_KINDS = (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType)
_PREFIX = "meta_"


@dataclasses.dataclass
class Snapshot:
    """What a version holds: files by name, folders of deleted positions with the files they touch, batches written."""

    version: int = 0
    schema: str | None = None
    files: dict[str, dict] = dataclasses.field(default_factory=dict)
    deletes: dict[str, dict[str, int]] = dataclasses.field(default_factory=dict)
    batches: dict[str, int] = dataclasses.field(default_factory=dict)

    def after(self, entry: dict) -> Snapshot:
        gone = set(entry.get("remove", ()))
        files = {n: f for n, f in self.files.items() if n not in gone} | {f["name"]: f for f in entry.get("add", ())}
        deletes = {p: {n: k for n, k in own.items() if n not in gone} for p, own in self.deletes.items()}
        if entry.get("delete"):
            deletes[entry["delete"]["path"]] = entry["delete"]["files"]
        return Snapshot(entry["version"], entry.get("schema") or self.schema, files, {p: own for p, own in deletes.items() if own}, self.batches | entry.get("batch", {}))

    def touched(self) -> dict[str, int]:
        """Deleted rows by file."""
        out: dict[str, int] = {}
        for own in self.deletes.values():
            for name, n in own.items():
                out[name] = out.get(name, 0) + n
        return out


class Store:
    """Versions of a table in a folder.

    ``promoted``: typed columns made from keys of the map column ``metadata``, as ``{"page": "long"}``.
    """

    def __init__(self, spark: SparkSession, path: str, promoted: dict[str, str] | None = None):
        self.spark, self.path, self.promoted = spark, path.rstrip("/"), promoted or {}

    # --- the log ---

    def version(self) -> int:
        return max((int(n[:20]) for n in self._logged() if n.endswith(".json")), default=0)

    def _logged(self) -> list[str]:
        return [n for n in _fs.names(self.spark, f"{self.path}/log") if n[:20].isdigit()]

    def _log(self, version: int, kind: str = "json") -> str:
        return f"{self.path}/log/{version:020d}.{kind}"

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The state after ``version``; of the newest one if none is given. ``ValueError`` if there is no such version."""
        logged = self._logged()
        numbers = sorted(int(n[:20]) for n in logged if n.endswith(".json"))
        last = numbers[-1] if numbers else 0
        version = last if version is None else version
        if not 0 <= version <= last:
            raise ValueError(f"no version {version}")
        sums = [int(n[:20]) for n in logged if n.endswith(".sum") and int(n[:20]) <= version]
        state = Snapshot(**json.loads(_fs.read(self.spark, self._log(max(sums), "sum")))) if sums else Snapshot()
        for v in range(state.version + 1, version + 1):
            state = state.after(json.loads(_fs.read(self.spark, self._log(v))))
        return state

    def _commit(self, base: Snapshot, entry: dict, reads: set[str] = frozenset()) -> bool:
        """Write ``entry`` as the next version; False if files it has ``reads`` of were changed since ``base``."""
        state = base
        while not _fs.put_new(self.spark, self._log(state.version + 1), json.dumps(entry | {"version": state.version + 1})):
            other = json.loads(_fs.read(self.spark, self._log(state.version + 1)))
            changed = set(other.get("remove", ())) | set(other.get("delete", {}).get("files", ()))
            if changed & reads or other.get("batch") and set(other["batch"].items()) & set(entry.get("batch", {}).items()):
                return False
            state = state.after(other)
        state = state.after(entry | {"version": state.version + 1})
        if state.version % SUMMARY == 0:
            _fs.put_new(self.spark, self._log(state.version, "sum"), json.dumps(dataclasses.asdict(state)))
        return True

    # --- files ---

    def _promote(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({_PREFIX + k: F.col("metadata")[k].try_cast(kind) for k, kind in self.promoted.items()}) if self.promoted else rows

    def _written(self, rows: DataFrame) -> list[dict]:
        """Write rows as new files; of each its name, rows, and its columns' least and greatest values."""
        folder = f"data/{uuid.uuid4().hex}"
        rows = self._promote(rows)
        rows.write.parquet(f"{self.path}/{folder}")
        plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, _KINDS) and f.name not in ("text", "content")]
        sums = [F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"), *[a.alias(f"{kind}{i}") for i, c in enumerate(plain) for kind, a in (("l", F.min(f"`{c}`")), ("h", F.max(f"`{c}`")), ("n", F.count_if(F.col(f"`{c}`").isNull())))]]
        back = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
        out = []
        for r in back.groupBy(F.col("_metadata.file_name").alias("name")).agg(*sums).collect():
            stats = {c: [r[f"l{i}"], r[f"h{i}"], r[f"n{i}"]] for i, c in enumerate(plain)}
            out.append({"name": r["name"], "folder": folder, "rows": r["rows"], "bytes": r["bytes"], "stats": {c: s for c, s in stats.items() if s[0] == s[0] and s[1] == s[1]}})
        return out

    def _schema(self, state: Snapshot) -> T.StructType:
        return T.StructType.fromJson(json.loads(state.schema))

    def _scan(self, state: Snapshot, names: list[str], placed: bool = False) -> DataFrame:
        """Rows of some files without deleted ones; with their places, _file and _row, if ``placed``."""
        schema = self._schema(state)
        if not names:
            none = self.spark.createDataFrame([], schema)
            return none.withColumns({"_file": F.lit(""), "_row": F.lit(0).cast("long")}) if placed else none
        raw = self.spark.read.schema(schema).parquet(*[f"{self.path}/{state.files[n]['folder']}/{n}" for n in names])
        folders = [p for p, own in state.deletes.items() if not own.keys().isdisjoint(names)]
        if not folders and not placed:
            return raw
        rows = raw.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
        if folders:
            gone = self.spark.read.schema("_file string, _row long").parquet(*[f"{self.path}/{p}" for p in folders])
            rows = rows.join(gone, ["_file", "_row"], "left_anti")
        return rows if placed else rows.drop("_file", "_row")

    def _rows(self, state: Snapshot, where: dict | None = None, placed: bool = False) -> DataFrame:
        """Files without deleted rows are read plainly; the others are joined with positions."""
        names = [n for n, f in state.files.items() if filters.may_match(where, self._bounds(f))]
        touched = state.touched()
        plain, mended = [n for n in names if n not in touched], [n for n in names if n in touched]
        rows = self._scan(state, plain, placed) if plain or not mended else None
        if mended:
            more = self._scan(state, mended, placed)
            rows = more if rows is None else rows.unionByName(more)
        return rows.where(self.condition(where)) if where else rows

    def _bounds(self, file: dict) -> dict[str, tuple]:
        out = {c: (*s, file["rows"]) for c, s in file["stats"].items()}
        return out | {k: out[_PREFIX + k] for k in self.promoted if _PREFIX + k in out}

    def condition(self, where: dict | None) -> Column:
        """The filter as a Column: promoted keys by their columns, others in the map."""

        def column(key: str, value: Any) -> Column:
            if key in self.promoted:
                return F.col(_PREFIX + key)
            own = F.col("metadata")[key]
            if isinstance(value, bool):
                return own.try_cast("boolean")
            return own.try_cast("double") if isinstance(value, (int, float)) else own

        return filters.compiled(where, column)

    def files(self, where: dict | None = None, version: int | None = None) -> list[str]:
        """Names of the files that may hold rows of a filter."""
        return [n for n, f in self.snapshot(version).files.items() if filters.may_match(where, self._bounds(f))]

    # --- rows ---

    def read(self, version: int | None = None, where: dict | None = None) -> DataFrame:
        """Rows of a version that pass a filter."""
        state = self.snapshot(version)
        if state.schema is None:
            raise ValueError(f"{self.path} holds no rows")
        return self._rows(state, where).drop(*[_PREFIX + k for k in self.promoted])

    def _entry(self, state: Snapshot, rows: DataFrame) -> dict:
        schema = self._promote(rows).schema
        if state.schema is not None:
            held = self._schema(state)
            if {(f.name, f.dataType.simpleString()) for f in schema.fields} != {(f.name, f.dataType.simpleString()) for f in held.fields}:
                raise ValueError(f"rows have {schema.simpleString()}, the store {held.simpleString()}")
            return {}
        fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
        return {"schema": T.StructType(fields).json()}

    def add(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Append rows, and say how many; nothing that is there is read or written.

        A ``batch`` (writer, number) that was written, or an earlier number, is left out.
        """
        state = self.snapshot()
        if batch and state.batches.get(batch[0], -1) >= batch[1]:
            return 0
        entry = self._entry(state, rows) | {"add": self._written(rows)} | ({"batch": {batch[0]: batch[1]}} if batch else {})
        # an append conflicts with nothing but the same batch of another run
        return sum(f["rows"] for f in entry["add"]) if self._commit(state, entry) else 0

    def _changed(self, make: Callable[[Snapshot], tuple[dict, set[str]] | None], tries: int = 10) -> None:
        for _ in range(tries):
            state = self.snapshot()
            made = make(state)
            if made is None or self._commit(state, *made):
                return
        raise RuntimeError(f"files changed {tries} times while they were read")

    def _positions(self, hits: DataFrame) -> dict:
        path = f"deletes/{uuid.uuid4().hex}"
        hits.select("_file", "_row").distinct().write.parquet(f"{self.path}/{path}")
        found = self.spark.read.parquet(f"{self.path}/{path}").groupBy("_file").count().collect()
        return {"path": path, "files": {r[0]: r[1] for r in found}}

    def delete(self, keys: DataFrame | None = None, key: str = "id", where: dict | None = None) -> None:
        """Delete the rows of some keys, or of a filter, by writing their positions."""

        def make(state):
            if state.schema is None:
                return None
            hits = self._rows(state, where, placed=True)
            hits = hits.join(keys.select(key).distinct(), key, "left_semi") if keys is not None else hits
            gone = self._positions(hits)
            return ({"delete": gone}, set(gone["files"])) if gone["files"] else None

        self._changed(make)

    def update(self, changes: DataFrame, key: str = "id") -> None:
        """Set the changes' values, where they are not null, in the rows of their keys; unknown keys are left out."""

        def make(state):
            if state.schema is None:
                return None
            rows = self._rows(state, placed=True).join(changes.select(key).distinct(), key, "left_semi")
            gone = self._positions(rows)
            if not gone["files"]:
                return None
            new = upserted(rows.drop("_file", "_row", *[_PREFIX + k for k in self.promoted]), changes, key)
            return {"delete": gone, "add": self._written(new)}, set(gone["files"])

        self._changed(make)

    def compact(self, least_rows: int = 1_000_000, most_bytes: int = 64 << 20) -> None:
        """Write files of fewer rows, and those with deleted rows, anew as files of about ``least_rows``, but ``most_bytes`` at most; the rows stay the same."""

        def make(state):
            touched = state.touched()
            old = [n for n, f in state.files.items() if n in touched or f["rows"] < least_rows and f.get("bytes", 0) < most_bytes // 2]
            if len(old) < 2 and not touched:
                return None
            live = sum(state.files[n]["rows"] - touched.get(n, 0) for n in old)
            size = sum(state.files[n].get("bytes", 0) for n in old)
            rows = self._scan(state, old).drop(*[_PREFIX + k for k in self.promoted])
            return {"remove": old, "add": self._written(rows.repartition(max(1, live // least_rows, -(-size // most_bytes))))}, set(old)

        self._changed(make)

    def peek(self, n: int = 5, key: str = "id") -> tuple[int, DataFrame]:
        """The number of rows, from the log alone, and the first ``n`` by key."""
        state = self.snapshot()
        return sum(f["rows"] for f in state.files.values()) - sum(state.touched().values()), self.read().orderBy(key).limit(n)

    def search(self, questions: DataFrame, k: int = C.TOP_K, where: dict | None = None, before: bool = True, kind: str = "l2") -> DataFrame:
        """query_id, id, score, rank and the other columns but the vector, of the best ``k`` of the rows ``(id, vector, ...)`` for each question.

        ``before``: the filter is applied to the rows before the best are taken;
        otherwise to the best, of which fewer may be left.
        """
        rows = self.read(where=where if before else None)
        hits = search.top_k(questions, rows.select("id", "vector"), k, kind)
        if before:
            return hits.join(rows.drop("vector"), "id").select("query_id", "id", "score", "rank", *[c for c in rows.columns if c not in ("id", "vector")])
        state = self.snapshot()
        kept = self._rows(state, where).drop("vector", *[_PREFIX + k for k in self.promoted])
        return hits.join(kept, "id").select("query_id", "id", "score", "rank", *[c for c in kept.columns if c != "id"])
