"""Repair of a conversation's turn structure at least cost.

A sound conversation is ``(s?(ua)+)?`` by the initials of its roles. Rows are kept
(0), given the role user or assistant (1), deleted (2; blank and repeated ones must
be), or inserted empty (5); a truncated row that is not deleted adds 5. Of the
cheapest edits those with the ASCII-least initials (D, I, K, R) are made.

A conversation's signature has a symbol for each row: its role's initial, large if
truncated, or x if it must go. Equal signatures have equal edits, so only distinct ones are
solved. They are sorted, and each task inserts its range into a prefix
trie: a node holds the least cost of each state of the pattern after its prefix, and
is made once for all signatures below it. As they come sorted, only the path
to the current signature is held, and a signature's answer is read from its path
when its terminal node is reached: backwards for the states on a cheapest way,
then forwards for the least letters.

Rows are dealt by conversation and sorted, and walked through with the edits
once: what is held is a batch, and a byte for each row of one conversation. The order of a
conversation's rows, and a digest of them, are one after another, so a conversation
is one task's work, however long; signatures that many conversations share
are solved once.

Nulls of role and text are one space; a null turn comes first; a null conv_id is a
conversation. Rows of one turn are ordered by role and text. A conversation
without rows has no edits. Long texts move whole. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize
from .sharding import CRC_TABLE, crc32_sql

_BLANKS = " \t\n\x0b\f\r"
#: States of the pattern: nothing yet, after s, after u, after a. What may come next, and where it leads.
_NEXT = ((("s", 1), ("u", 2)), (("u", 2),), (("a", 3),), (("u", 2),))
_LAST = (0, 3)
_FAR = 1 << 60
_ROLES = {"u": "user", "a": "assistant"}


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after a fixed damage of each row, by CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(_plain("text"), ".!?", "")).otherwise(_plain("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(_plain("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


# --- edits of a signature ---


def _edges() -> dict[str, list[tuple[int, int, str, int]]]:
    """Of each symbol: (state, next state, letter, cost) of what may be done with its row."""
    out = {}
    for symbol in "suaoSUAOx":
        edges = [(state, state, "D", 2) for state in range(4)]
        if symbol != "x":
            more = 5 if symbol.isupper() else 0
            for state, follow in enumerate(_NEXT):
                for role, then in follow:
                    if role == symbol.lower():
                        edges.append((state, then, "K", more))
                    elif role in _ROLES:
                        edges.append((state, then, "R", more + 1))
        out[symbol] = edges
    return out


EDGES = _edges()
#: Rows that may be inserted: (state, next state).
INSERTS = [(state, then) for state, follow in enumerate(_NEXT) for role, then in follow if role in _ROLES]


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        for state, then in INSERTS:
            if costs[state] + 5 < costs[then]:
                costs[then] = costs[state] + 5
    return tuple(costs)


def _layer(above: tuple[int, ...], symbol: str) -> tuple[int, ...]:
    """The least cost of each state after one more row."""
    costs = [_FAR] * 4
    for state, then, _, cost in EDGES[symbol]:
        if above[state] + cost < costs[then]:
            costs[then] = above[state] + cost
    return _with_inserts(costs)


def _cheapest(signature: str, layers: list[tuple[int, ...]]) -> tuple[int, str]:
    """Cost and letters of the least of the cheapest edits, from a path's layers."""
    end = len(signature)
    cost = min(layers[end][s] for s in _LAST)
    good = bytearray(end + 1)  # states on a cheapest way, as bits
    for i in range(end, -1, -1):
        own = layers[i]
        bits = 0
        if i == end:
            bits = sum(1 << s for s in _LAST if own[s] == cost)
        else:
            for state, then, _, c in EDGES[signature[i]]:
                if good[i + 1] >> then & 1 and own[state] + c == layers[i + 1][then]:
                    bits |= 1 << state
        for _ in range(3):
            for state, then in INSERTS:
                if bits >> then & 1 and own[state] + 5 == own[then]:
                    bits |= 1 << state
        good[i] = bits
    letters, i, now = [], 0, 1
    while True:
        own = layers[i]
        if i == end and any(now >> s & 1 and own[s] == cost for s in _LAST):
            return cost, "".join(letters)
        steps: dict[str, int] = {}
        if i < end:
            for state, then, letter, c in EDGES[signature[i]]:
                if now >> state & 1 and good[i + 1] >> then & 1 and own[state] + c == layers[i + 1][then]:
                    steps[letter] = steps.get(letter, 0) | 1 << then
        for state, then in INSERTS:
            if now >> state & 1 and good[i] >> then & 1 and own[state] + 5 == own[then]:
                steps["I"] = steps.get("I", 0) | 1 << then
        letter = min(steps)
        letters.append(letter)
        now = steps[letter]
        i += letter != "I"


class Trie:
    """The path to the signature inserted last, with a layer for each node."""

    def __init__(self):
        self.path, self.layers, self.made = "", [_with_inserts([0, _FAR, _FAR, _FAR])], 1

    def insert(self, signature: str) -> tuple[int, str]:
        """Cost and letters of a signature; those that share a prefix should come one after the other."""
        shared, most = 0, min(len(self.path), len(signature))
        while shared < most and self.path[shared] == signature[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for symbol in signature[shared:]:
            self.layers.append(_layer(self.layers[-1], symbol))
            self.made += 1
        self.path = signature
        return _cheapest(signature, self.layers)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        signatures = batch.column(0).to_pylist()
        found = [trie.insert(s) for s in signatures]
        yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.string()), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])


def solve(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit of each distinct value of ``signatures (signature)``."""
    return signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(_solved, "signature string, cost long, audit string")


# --- conversations ---


def signed(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn, role, text, symbol, fault and illegal of each row of ``rows (conv_id, turn, role, text)``."""
    order = [F.asc_nulls_first("turn")]
    rows = rows.select("conv_id", "turn", _plain("role").alias("role"), _plain("text").alias("text")).repartition("conv_id")
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(*order)) > 1)
    rows = rows.withColumns({"initial": F.substring("role", 1, 1), "body": F.rtrim(F.col("text"), F.lit(_BLANKS))})
    fault = F.when(F.col("body") == "", "blank").when(F.col("again"), "duplicate").when(~F.substring(F.col("body"), -1, 1).isin(".", "!", "?"), "truncated")
    along = Window.partitionBy("conv_id").orderBy(*order, "role", "text", "again")
    pair = F.concat(F.lag("initial").over(along), F.col("initial"))
    rows = rows.withColumns({"place": F.row_number().over(along).cast("long"), "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)), "fault": fault})
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("o"))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("x")).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return rows.select("conv_id", "place", "turn", "role", "text", symbol.alias("symbol"), "fault", "illegal")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def plan(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conv_id of ``conversations``; ``rows`` as ``signed`` gives them."""
    heads = conversations.select("conv_id").distinct()
    # a row without a symbol stands for a conversation, so that those without rows stay
    both = rows.select("conv_id", "place", "turn", "symbol", "fault", "illegal").unionByName(heads, allowMissingColumns=True)
    fault = lambda name: F.count_if(F.col("fault") == name).alias(name)
    signs = F.array_sort(F.collect_list(F.when(F.col("symbol").isNotNull(), F.struct("place", "symbol"))))
    sums = both.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        fault("blank"), fault("duplicate"), fault("truncated"), F.count_if("illegal").alias("illegal"),
        F.array_join(F.transform(signs, lambda x: x["symbol"]), "").alias("signature"),
    )
    sums = materialize(sums, "signatures")
    return sums.join(solve(sums), "signature").select("conv_id", *_COUNTS, "audit")


class _Walk:
    """Follows a conversation's letters and says what becomes of its rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.out = audit, 0, 0
        self.first = (len(audit) - audit.count("D")) % 2  # a system row before the pairs

    def _role(self) -> str:
        return "assistant" if (self.out - self.first) % 2 else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self._role(), "", "I"
            self.at += 1
            self.out += 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield (role if letter == "K" else self._role()), text, letter
            self.out += 1


def _stream(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, at place 0, then its rows, in order, in one partition."""
    both = plans.withColumn("place", F.lit(0).cast("long")).unionByName(rows.select("conv_id", "place", "turn", "role", "text"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "place")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text, edit (I, K or R) of the conversations as repaired; an inserted row has no turn. ``rows`` of ``signed``, ``plans`` of ``plan``."""
    stream = _stream(rows, plans).select("conv_id", "place", "audit", "turn", "role", "text")

    def walk(batches):
        now, conv, place = None, None, 0
        out: list[tuple] = []

        def put(turn, found):
            nonlocal place
            for role, text, edit in found:
                place += 1
                out.append((conv, place, None if edit == "I" else turn, role, text, edit))

        def batch_of():
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "place", "turn", "role", "text", "edit"])
            out.clear()
            return made

        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, pa.int64(), batch.schema.field("turn").type, pa.string(), pa.string(), pa.string()]
            for own, at, audit, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == 0:
                    if now:
                        put(None, now.inserted())
                    now, conv, place = _Walk(audit), own, 0
                else:
                    put(turn, now.row(role, text))
            yield batch_of()
        if now:
            put(None, now.inserted())
            yield batch_of()

    types = dict(stream.dtypes)
    return stream.mapInArrow(walk, f"conv_id {types['conv_id']}, place long, turn {types['turn']}, role string, text string, edit string")


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans with repaired_sha256: of the repaired rows as ``role:text``, joined by newlines."""
    stream = _stream(rows, plans).select("conv_id", "place", *_COUNTS, "audit", "role", "text")

    def walk(batches):
        now, head, sha = None, None, None

        def put(found):
            for role, text, _ in found:
                sha.update(("\n" if now.out else "").encode() + f"{role}:{text}".encode())

        def ended():
            put(now.inserted())
            return (*head, sha.hexdigest())

        for batch in batches:
            done = []
            for *own, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own[1] == 0:
                    if now:
                        done.append(ended())
                    now, head, sha = _Walk(own[-1]), (own[0], *own[2:]), hashlib.sha256()
                else:
                    put(now.row(role, text))
            kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
            yield _table(done, kinds)
        if now:
            yield _table([ended()], kinds)

    def _table(done, kinds):
        columns = list(zip(*done, strict=True)) if done else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

    return stream.mapInArrow(walk, f"conv_id {dict(stream.dtypes)['conv_id']}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """The repaired rows of ``turns (conv_id, turn, role, text)``."""
    rows = materialize(signed(turns), "turns")
    return repaired(rows, plan(rows, turns))


def repair_digests(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Counts, cost, audit and digest of each conversation of ``turns``, and of those of ``conversations`` that have no turn."""
    rows = materialize(signed(turns), "turns")
    return digests(rows, plan(rows, turns if conversations is None else conversations))


def _ways() -> list[tuple[str, int, int, str, int]]:
    """(symbol, state, next state, letters, cost) of a row's edit followed by up to two inserts; symbol '' is the start."""

    def more(symbol, state, then, letters, cost):
        yield symbol, state, then, letters, cost
        if letters.count("I") < 2:
            for a, b in INSERTS:
                if a == then:
                    yield from more(symbol, state, b, letters + "I", cost + 5)

    out = list(more("", 0, 0, "", 0))
    for symbol, edges in EDGES.items():
        for state, then, letter, cost in edges:
            out += more(symbol, state, then, letter, cost)
    return out


def oracle() -> str:
    """DuckDB SQL: the same recurrence over conversations, row by row, without a trie."""
    ways = ", ".join(f"('{s}', {a}, {b}, '{letters}', {c})" for s, a, b, letters, c in _ways())
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
w(symbol, state, next, letters, c) AS (VALUES {ways}),
k AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(key)} % 20 AS kind FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS u(copy)),
g AS (SELECT *, substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM d),
r AS MATERIALIZED (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    row_number() OVER o AS place, lag(initial) OVER o || initial AS pair
  FROM g WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
y AS MATERIALIZED (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END)
    WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS symbol FROM r),
s AS MATERIALIZED (
  SELECT i.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(string_agg(symbol, '' ORDER BY place), '') AS signature
  FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM i.conv_id GROUP BY i.conv_id),
p(signature, i, state, best) AS (
  SELECT q.signature, 0, next, min({{'cost': c, 'audit': letters}}) FROM (SELECT DISTINCT signature FROM s) q, w WHERE symbol = '' GROUP BY ALL
  UNION ALL
  SELECT p.signature, p.i + 1, w.next, min({{'cost': p.best.cost + w.c, 'audit': p.best.audit || w.letters}})
  FROM p JOIN w ON w.symbol = p.signature[p.i + 1] AND w.state = p.state WHERE p.i < length(p.signature) GROUP BY ALL),
e AS (SELECT signature, min(best) AS best FROM p WHERE i = length(signature) AND state IN (0, 3) GROUP BY signature),
a AS (SELECT s.*, e.best.cost AS cost, e.best.audit AS audit FROM s JOIN e USING (signature)),
j AS (
  SELECT conv_id, audit, u.j AS j, audit[u.j] AS letter, length(replace(audit[1:u.j], 'I', '')) AS place, length(replace(audit[1:u.j - 1], 'D', '')) AS k,
    length(replace(audit, 'D', '')) % 2 AS first FROM a, unnest(range(1, length(audit) + 1)) AS u(j)),
f AS (
  SELECT j.conv_id, string_agg((CASE WHEN letter = 'K' THEN y.role WHEN (k - first) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || CASE WHEN letter = 'I' THEN '' ELSE y.text END, chr(10) ORDER BY j.j) AS repaired
  FROM j LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM j.conv_id AND y.place = j.place WHERE letter <> 'D' GROUP BY j.conv_id)
SELECT a.conv_id, gaps, blank, duplicate, truncated, illegal, cost::BIGINT AS cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id
"""
