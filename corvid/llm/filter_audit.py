"""What a chain of filters removes, in every order.

One filter removes later copies: texts equal to the text of a smaller doc_id. They
are found by refining a partition. Texts are first split by their number of code
points, then by the hashes of successive blocks (64 code points, then eight times as
many each round), and after each round classes of a single doc_id are dropped. The
first scan writes one row of some 100 bytes for each document, with its length
and block hashes; rounds read and write only these. Texts whose blocks are all equal are
then compared: each with the text of the least doc_id of its class, and, should a
class hold different texts, those with each other.

Only texts of classes that are left move: a list of at most ``SIEVE`` remainders of
their keys, which is broadcast, keeps most others at the scan; what it lets through
goes to an exact join. With many more classes than that the list lets all through,
and all texts move once. A class may hold a third of all rows: counts are made
before the shuffle, and joins are equi-joins with one row for each class, which
adaptive execution can split.

Each document then has a mask of the filters that it fails. Masks are counted by
part, with labels; every order of filters follows from these counts (32 for each part).

Null and empty texts are the empty text. A null doc_id is neither smaller nor
larger than another, so such a row is no copy and makes none. Rows with equal doc_id
are no copies of each other, but are both copies of a smaller one. Of several labels
of a doc_id, 1 counts. A null source is the part ''. Long texts are hashed and
compared whole. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize, release

#: Code points of the first block, and how much larger each further one is.
BLOCK, GROWTH = 64, 8
#: Entries of the list that is broadcast, at most.
SIEVE = 1 << 19
#: Blocks of the longest text that a string can hold.
_BLOCKS = 10
_SPACE = r"[\x20\x09-\x0D]+"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _spans() -> list[tuple[int, int]]:
    """(first code point from 1, size) of each block."""
    out, at = [], 1
    for k in range(_BLOCKS):
        out.append((at, BLOCK * GROWTH**k))
        at += BLOCK * GROWTH**k
    return out


def _block_hashes(bits: int) -> list[Column]:
    """The hash of each block of ``text``, of ``length`` code points; null beyond its end."""
    cut = lambda at, size: F.shiftright(F.xxhash64(F.substring("text", at, min(size, (1 << 31) - 1))), 64 - bits)
    return [F.when(F.col("length") >= at, cut(at, size)).alias(f"h{k}") for k, (at, size) in enumerate(_spans()) if at < 1 << 31]


def _key(hashes: list[str]) -> Column:
    """The name of a length and the blocks up to some round; nulls, beyond a text's end, leave it as it is."""
    return F.xxhash64("length", *hashes)


def _measured(docs: DataFrame, *more: Column) -> DataFrame:
    """id, length and text of the rows that have a doc_id."""
    return docs.where("doc_id is not null").select(*more, F.col("doc_id").cast("long").alias("id"), _text().alias("text")).withColumn("length", F.char_length("text"))


def later_copies(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The rows of ``docs (doc_id, text, ...)``, all columns, whose text a smaller doc_id has too.

    ``bits``: of a block's hash; fewer make more classes of different texts, never other results.
    """
    classes = _classes(docs, bits)
    hashes = _block_hashes(bits)
    names = [f"h{k}" for k in range(len(hashes))]
    keyed = _measured(docs, F.struct("*").alias("row")).select("row", "id", "text", "length", *hashes).select("row", "id", _key(names).alias("key"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    sieve = F.broadcast(classes.select(F.pmod("key", F.lit(SIEVE)).alias("sieve")).distinct())
    # an inner join with distinct values: a semi join would be planned below the hashes and make them twice
    sifted = keyed.withColumn("sieve", F.pmod("key", F.lit(SIEVE))).join(sieve, "sieve").drop("sieve")
    members = materialize(sifted.join(classes, "key"), "members")
    first = materialize(members.where("id = least").groupBy("key").agg(F.first(text).alias("first")), "first")
    compared = materialize(members.join(first, "key").withColumn("same", text == F.col("first")).drop("first"), "compared")
    release(classes, members, first)
    other = compared.where("not same")
    out = compared.where("same and id > least").select("row.*")
    if not other.isEmpty():
        other = other.withColumn("text", text)
        least_of = other.groupBy("key", "text").agg(F.min("id").alias("own"))
        out = out.union(other.join(least_of, ["key", "text"]).where("id > own").select("row.*"))
    return out


def _classes(docs: DataFrame, bits: int) -> DataFrame:
    """key, least: the classes of two doc_ids or more whose lengths and blocks all agree, with their least doc_id."""
    hashes = _block_hashes(bits)
    names = [f"h{k}" for k in range(len(hashes))]
    signed = materialize(_measured(docs).select("id", "length", *hashes), "refine")
    reached = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    deepest = signed.agg(F.coalesce(F.max(reached), F.lit(0))).first()[0]
    alive, tables, done = signed, [signed], []
    for k in range(deepest + 1):
        # by length first, then by one block after the other; classes of one doc_id go
        alive = alive.withColumn("key", _key(names[:k]))
        groups = alive.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last").drop("last")
        groups = materialize(groups, "groups")
        left = materialize(alive.join(groups, "key"), "refine")
        tables += [groups, left]
        done.append(left.where(reached == k).select("key", "least").distinct())
        alive = left.where(reached > k).drop("key", "least")
    out = materialize(functools.reduce(DataFrame.union, done), "classes")
    release(*tables)
    return out


def standard_filters() -> dict:
    """Failure conditions, by letter, as functions of a text and its words."""
    return {
        "A": lambda text, words: F.size(words) < 200,
        "B": lambda text, words: 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.char_length(text).cast("long"),
        "D": lambda text, words: text.rlike(r"[#$%&*|]"),
    }


def _masked(rows: DataFrame, filters: dict) -> DataFrame:
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), _text().alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    mask = F.lit(0)
    for k, fails in enumerate(filters.values()):
        mask = mask + F.when(fails(F.col("text"), F.col("words")), F.lit(1 << k)).otherwise(F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict) -> DataFrame:
    """part, mask, n, good, toxic: rows of each part by the set of filters that they fail; the last bit is that of later copies."""
    copy = 1 << len(filters)
    rows = _masked(docs, filters).withColumn("n", F.lit(1))
    # a copy was counted without its bit above: take it from there, add it with its bit
    copies = _masked(later_copies(docs), filters)
    moved = copies.withColumn("n", F.lit(-1)).union(copies.select("doc_id", "part", (F.col("mask") + copy).alias("mask"), F.lit(1)))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    by_id = rows.union(moved).join(known, "doc_id", "left")
    return by_id.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict | None = None, copies: str = "E") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each part, order and step.

    ``filters``: by letter, functions of a text and its words that give a failure
    condition on ``docs (doc_id, text, source)``; the filter ``copies`` fails later copies and comes last in the mask. ``labels
    (doc_id, quality, toxic)``.
    """
    filters = standard_filters() if filters is None else filters
    letters = [*filters, copies]
    sums = materialize(mask_counts(docs, labels, filters), "masks")
    # one row for each part and pair of a filter and the set of those before it
    steps = [(before, k) for k in range(len(letters)) for before in range(1 << len(letters)) if not before >> k & 1]
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(k).alias("k"), F.lit(1 << k).alias("own")) for b, k in steps])).alias("s")
    each = sums.select("*", pairs).select("part", "mask", "n", "good", "toxic", F.col("s.before").alias("before"), F.col("s.k").alias("k"), F.col("s.own").alias("own"))
    own = F.col("own")
    fails, earlier = F.col("mask").bitwiseAND(own) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda name, on: F.sum(F.when(on, F.col(name)).otherwise(0)).alias
    found = each.groupBy("part", "k", "before").agg(
        total("n", ~fails & ~earlier)("kept"),
        total("n", fails & ~earlier)("removed"),
        total("n", fails & earlier)("redundant"),
        total("n", F.col("mask") == own)("unique_fails"),
        total("good", fails & ~earlier)("good_lost"),
        total("toxic", fails & ~earlier)("toxic_lost"),
    )
    size = F.bit_count("before")
    orders_with = F.element_at(F.array(*[F.lit(math.factorial(i) * math.factorial(len(letters) - 1 - i)) for i in range(len(letters))]), size + 1)
    shares = found.groupBy("part", "k").agg(F.sum(F.col("removed") * orders_with).alias("shapley"))
    listed = []
    for order in itertools.permutations(range(len(letters))):
        before = 0
        for step, k in enumerate(order, 1):
            listed.append(("".join(letters[i] for i in order), step, k, before))
            before |= 1 << k
    orders = F.broadcast(docs.sparkSession.createDataFrame(listed, "filter_order string, step int, k int, before int"))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return found.join(shares, ["part", "k"]).join(orders, ["k", "before"]).select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in names])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
first AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM d JOIN first USING (text) LEFT JOIN known USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, list_transform(string_split(filter_order, '')[1:step - 1], lambda y: ascii(y) - 64) AS earlier, ascii(filter_order[step]) - 64 AS k FROM o, unnest(range(1, 6)) AS u(step)),
x AS (SELECT part, filter_order, step, k, n, good, toxic, fails[k] AS own, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda y: y)) = 1 AS sole FROM c, s),
r AS (
  SELECT part, filter_order, step::INTEGER AS step, k, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND sole), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r
"""
