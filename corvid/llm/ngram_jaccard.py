"""Near duplicates by n-gram Jaccard, as a blocked sparse matrix product.

Rows of the matrix are sets of word n-grams (documents with one set are one
row), columns are n-grams. Its product with its own transpose holds the
overlaps. Only entries that can reach the threshold are computed, block of
columns by block of columns, and an entry is dropped as soon as what it has
and what its rows still hold can't reach the bound.

*Bounds.* Of a row of ``n`` n-grams, a row that links with it has at least
``ceil(n * percent / 100)``; it may lack ``d`` others. So the first ``2d + 1``
n-grams of a row in any fixed order (here: by name), its *head*, share at least
``least(d, d') + 1`` n-grams with the head of a row that links with it.

*Columns.* Heads give the column counts: n-grams of one row only can't
count. A row whose head has fewer n-grams with company than that bound links
with nothing. Of the others, the rarest are kept, so many that two
rows that link must still share one: the head's n-grams with company less the
bound, plus one. N-grams of common passages or lines are thus left out wherever
a row has enough others.

*Product.* Each column's *centre* is the row with the fewest n-grams without
company in its head, as an original has fewer than its edited copies. Each row
is first multiplied with the centre with which it shares most columns: as many
entries as rows. The links found make a forest, whose roots stand for its rows.
Rows that share a column but no root are then indexed by their whole rows,
n-grams that only rows of one root have first, then from rare to common: a pair
that links shares one of the first ``d + 1``, at ranks that leave room for the
overlap it needs. Edited copies that are too far from each other share none, so
that no pair of them is formed. Of two rows the smaller one must have its n-gram
so early that a row of its own size could still be reached, so that rows with a common
template that is too short for the threshold are not compared. In each of these columns the rows are multiplied
with the first of them, which joins more roots, and what still has different
roots is multiplied pair by pair, each pair once, at the first n-gram it shares.
Pairs below one root can't change the classes, so a group of copies costs no
square of its size; what remains are pairs close to the threshold.
An entry's columns are dealt to four blocks by name. The overlap of the first
block is counted; entries that can't reach the bound with all that the
remaining blocks of the smaller row hold go before the others are counted.

What is shuffled: the head's names twice (about 0.3 an n-gram), texts of the
rows that are left, n-grams of those that share columns with other roots, and
the blocks of each multiplied pair. Sums are
written before they are joined, so that Spark can split hot columns and sets.

Nulls and texts without words: n_shingles 0, own component. Texts with fewer
words than ``n`` have one shingle, their whole sequence. Repeated rows are
returned as often as given; rows that share a doc_id but not their text are
classed each by its own text. Ties don't matter: classes depend on links only.
Very long texts are one row of the matrix; the largest takes about 40 times its
bytes in its task. A null doc_id gets a null component and links with nothing.
Extra columns are ignored; an empty table gives an empty result. N-grams and
sets have 64-bit names; among 10**9 different sets the odds that any two share
a name are 3 in 100.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._components import components
from ._store import materialize, release

BLOCKS = 4


def shingles(data: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the word n-grams of a text (A-Z folded)."""
    words = T.word_hashes(data, *T.word_bounds(data), lower=True)
    if not len(words):
        return words.view(np.int64)
    return np.unique(T.to_signed(T.gram_hashes(words, min(n, len(words))) + T.U64(min(n, len(words)))))


def name(grams: np.ndarray) -> int:
    """The name of a set."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def lacks(size: int, percent: int) -> int:
    """How many of its n-grams a row may lack in one that it links with."""
    return size - -(-size * percent // 100)


def least_shared(size: int, percent: int) -> int:
    """How many n-grams of its head a row shares at least with that of one it links with."""
    return lacks(-(-size * percent // 100), percent) + 1


def head(grams: np.ndarray, percent: int) -> np.ndarray:
    return grams[: 2 * lacks(len(grams), percent) + 1]


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in T.parts(batch):
                sets = [(len(grams), name(grams)) for grams in (shingles(data, n) for data in T.texts(part.column(part.schema.get_field_index("text"))))]
                own = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "key")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[k] for r in sets], pa.int64()) for k in range(2))], ["doc_id", "key", "n_shingles", "set_id"])

    return run


def _heads(n: int, percent: int, most_seen: int = 1_000_000):
    """(gram, set_id, size) of each row's head; of copies in a task one is enough."""

    def run(batches):
        seen: set[int] = set()
        for ids, datas in T.each(batches):
            out: list[np.ndarray] = []
            rows: list[tuple[int, int, int]] = []
            for d, data in zip(ids, datas, strict=True):
                grams = shingles(data, n)
                if d is None or not len(grams) or (own := name(grams)) in seen:
                    continue
                if len(seen) >= most_seen:
                    seen.clear()
                seen.add(own)
                out.append(head(grams, percent))
                rows.append((own, len(grams), len(out[-1])))
            if out:
                own, sizes, times = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.repeat(own, times)), pa.array(np.repeat(sizes, times).astype(np.int32))], ["gram", "set_id", "size"])

    return run


def _rows(n: int):
    """Each text's row of the matrix, its n-grams dealt to blocks of columns."""

    def run(batches):
        for ids, datas in T.each(batches):
            sets = [shingles(data, n) for data in datas]
            deal = [(T.mix(g.view(np.uint64)) >> T.U64(40)).astype(np.int64) % BLOCKS for g in sets]
            blocks = [pa.array([g[at == k] for g, at in zip(sets, deal, strict=True)], pa.list_(pa.int64())) for k in range(BLOCKS)]
            sizes = pa.array([np.bincount(at, minlength=BLOCKS).tolist() for at in deal], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([name(g) for g in sets], pa.int64()), sizes, *blocks], ["set_id", "sizes", *(f"b{k}" for k in range(BLOCKS))])

    return run


def _reaches(percent: int, counted: int) -> F.Column:
    """Whether the overlap of ``counted`` blocks and the least that either row holds in the others can reach the bound."""
    total = lambda side: sum((F.col(f"{side}.sizes")[k] for k in range(BLOCKS)), F.lit(0))
    rest = sum((F.least(F.col("x.sizes")[k], F.col("y.sizes")[k]) for k in range(counted, BLOCKS)), F.lit(0))
    return (F.col("overlap") + rest) * (100 + percent) >= (total("x") + total("y")) * percent


def _multiplied(pairs: DataFrame, rows: DataFrame, percent: int, tag: str) -> DataFrame:
    """The pairs (a, b) of rows that link."""

    def more(pairs, columns, new):
        one = rows.select(F.col("set_id").alias("a"), F.struct(*columns).alias("x"))
        two = rows.select(F.col("set_id").alias("b"), F.struct(*columns).alias("y"))
        overlap = sum((F.size(F.array_intersect(F.col(f"x.{c}"), F.col(f"y.{c}"))) for c in new), F.lit(0))
        return pairs.join(one, "a").join(two, "b").withColumn("overlap", F.col("overlap") + overlap)

    rest = [f"b{k}" for k in range(1, BLOCKS)]
    first = more(pairs.select("a", "b", F.lit(0).alias("overlap")), ["sizes", "b0"], ["b0"]).where(_reaches(percent, 1)).select("a", "b", "overlap")
    return materialize(more(first, ["sizes", *rest], rest).where(_reaches(percent, BLOCKS)).select("a", "b"), tag)


def _sides(index: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The entries that a pair's smaller and larger row may have at the first n-gram that they share.

    What the smaller row still holds from its rank on must reach the overlap of two
    rows of its size, at least; of the others only those of columns with such a row, and
    of a size that it can reach, are left. Rows that share a template below the
    threshold have no such entries, however many they are.
    """
    held = (F.col("size") - F.col("rank") + 1) * (100 + percent)
    one = index.where(held >= 2 * F.col("size") * percent)
    least = one.groupBy("gram").agg(F.min("size").alias("least"))
    two = index.join(least, "gram").where(held >= (F.col("size") + F.col("least")) * percent).drop("least")
    return one, two


def _roots(forest: DataFrame) -> DataFrame:
    """(node, root) of a written forest (a, b), b the parent, by doubling steps."""
    forest = forest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    steps = []
    while True:
        up = forest.select(F.col("node").alias("root"), F.col("root").alias("above"))
        steps.append(materialize(forest.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots"))
        forest = steps[-1].select("node", "root")
        if steps[-1].where("moved").isEmpty():
            release(*steps[:-1])
            return steps[-1]


def _classes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, key, n_shingles, component_id for each row of ``docs (doc_id, text, key)``."""
    if not 51 <= percent <= 100:
        raise ValueError("percent must be from 51 to 100")
    profile = materialize(docs.mapInArrow(_profile(n), "doc_id long, key long, n_shingles long, set_id long"), "sets")
    classes = materialize(profile.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "classes")

    # columns of the heads
    heads = docs.mapInArrow(_heads(n, percent), "gram long, set_id long, size int")
    common = materialize(heads.groupBy("gram").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi"), F.count(F.lit(1)).alias("df")).where("lo < hi").select("gram", "df"), "columns")
    held = heads.join(common, "gram").groupBy("set_id", "size").agg(F.sort_array(F.collect_set(F.struct("df", "gram"))).alias("grams"))
    up = f"(size * {percent} + 99) div 100"  # the least size of a row that links
    held = held.withColumn("bound", F.expr(f"{up} - ({up} * {percent} + 99) div 100 + 1")).where("size(grams) >= bound")
    alone = F.expr(f"2 * (size - {up}) + 1 - size(grams)")
    entries = held.select("set_id", "size", alone.alias("alone"), F.explode(F.expr("slice(grams, 1, size(grams) - bound + 1)")).alias("g")).select(F.col("g.gram").alias("gram"), "set_id", "size", "alone")
    entries = materialize(entries, "entries")
    centres = entries.groupBy("gram").agg(F.min(F.struct("alone", "set_id", "size")).alias("centre"), F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi")
    centres = materialize(centres.select("gram", F.col("centre.set_id").alias("centre"), F.col("centre.size").alias("centre_size")), "centres")
    met = materialize(entries.join(centres, "gram").select("gram", "set_id", "size", "centre", "centre_size"), "met")
    release(common, entries, centres)
    wanted = met.select("set_id").distinct().join(classes, "set_id").select(F.col("first_id").alias("doc_id")).distinct()
    texts = docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    schema = "set_id long, sizes array<long>, " + ", ".join(f"b{k} array<long>" for k in range(BLOCKS))
    rows = materialize(texts.mapInArrow(_rows(n), schema).dropDuplicates(["set_id"]), "rows")

    # each row times one centre: a forest, as a centre comes before its rows by (alone, set_id)
    stars = met.where((F.col("set_id") != F.col("centre")) & (F.least("size", "centre_size") * 100 >= F.greatest("size", "centre_size") * percent))
    stars = stars.groupBy("set_id", "centre").agg(F.count(F.lit(1)).alias("shared")).groupBy("set_id").agg(F.max(F.struct("shared", "centre")).alias("best")).select(F.col("set_id").alias("a"), F.col("best.centre").alias("b"))
    forest = _multiplied(stars, rows, percent, "forest")
    roots = _roots(forest)

    # rows that share a column, but no root
    root = roots.select(F.col("node").alias("set_id"), "root")
    placed = materialize(met.select("gram", "set_id", "size").join(root, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "placed")
    mixed = materialize(placed.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram"), "mixed")
    apart = materialize(placed.join(mixed, "gram"), "apart")
    release(met, placed, mixed)
    # their whole rows; n-grams that only rows of one root have are in no overlap that counts
    own = apart.select("set_id", "size", "root").distinct()
    cells = rows.join(own, "set_id").select("set_id", "size", "root", F.explode(F.concat(*(f"b{k}" for k in range(BLOCKS)))).alias("gram"))
    company = cells.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("df")).where("lo < hi").select("gram", "df")
    company = materialize(company, "company")
    sorted_ = cells.join(company, "gram").groupBy("set_id", "size", "root").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    # ranks count the n-grams without company first; a row that links shares one of the first size - up + 1
    spare = f"greatest(0, size(grams) - {up} + 1)"
    kept = sorted_.select("set_id", "size", "root", F.expr("size - size(grams) + 1").alias("first"), F.expr(f"transform(slice(grams, 1, {spare}), g -> g.gram)").alias("grams"))
    index = kept.select("set_id", "size", "root", "first", "grams", F.posexplode("grams").alias("at", "gram"))
    index = materialize(index.select("set_id", "size", "root", (F.col("first") + F.col("at")).alias("rank"), "gram", F.expr("slice(grams, 1, at)").alias("before")), "index")

    def may_link(p: str, q: str) -> F.Column:
        """Whether the overlap can suffice if a shared n-gram is the first one: what stands before it isn't shared."""
        reach = F.least(F.col(f"{p}.size") - F.col(f"{p}.rank"), F.col(f"{q}.size") - F.col(f"{q}.rank")) + 1
        return (F.col(f"{p}.root") != F.col(f"{q}.root")) & (reach * (100 + percent) >= (F.col(f"{p}.size") + F.col(f"{q}.size")) * percent)

    of = lambda side: root.select(F.col("set_id").alias(side), F.col("root").alias(f"{side}_root"))
    at_roots = lambda links: links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    # once more with one row of each column, the one with the fewest n-grams before it
    lead = index.groupBy("gram").agg(F.min(F.struct("rank", "set_id", "size", "root")).alias("q"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram", "q")
    lead = materialize(lead, "lead")
    led = index.alias("p").join(lead, "gram").where(may_link("p", "q")).select(F.col("p.set_id").alias("a"), F.col("q.set_id").alias("b")).distinct()
    links = at_roots(_multiplied(led, rows, percent, "led"))
    joined = materialize(components(links).withColumnRenamed("node", "root"), "joined")
    index_all, index = index, materialize(index.join(joined, "root", "left").withColumn("root", F.coalesce("component", "root")).drop("component"), "index")
    release(index_all, lead)
    # all others: each pair at the first n-gram that both share
    one, two = (side.alias(name) for side, name in zip(_sides(index, percent), "pq", strict=True))
    ordered = (F.col("p.size") < F.col("q.size")) | ((F.col("p.size") == F.col("q.size")) & (F.col("p.set_id") < F.col("q.set_id")))
    rest = one.join(two, (F.col("p.gram") == F.col("q.gram")) & ordered & may_link("p", "q") & ~F.arrays_overlap("p.before", "q.before"))
    rest = materialize(rest.select(F.col("p.set_id").alias("a"), F.col("q.set_id").alias("b")), "rest")
    more = _multiplied(rest, rows, percent, "links")
    release(apart, company, index, rest, rows, forest)

    # roots that further links join
    links = joined.select(F.col("root").alias("a"), F.col("component").alias("b")).union(at_roots(more))
    found = components(links).withColumnRenamed("node", "root")
    # the least doc_id of each class, for sets of several documents and sets that link
    linked = classes.join(root, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")).join(found, "root", "left").withColumn("component", F.coalesce("component", "root"))
    linked = materialize(linked.select("set_id", "first_id", "copies", "component"), "linked")
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("copies")).where("copies > 1").select("component", "component_id")
    least = materialize(least, "least")
    named = materialize(linked.join(least, "component").select("set_id", "component_id"), "named")
    release(classes, roots, more, joined, linked, least)
    real = F.col("n_shingles") > 0
    return profile.join(named, "set_id", "left").select("doc_id", "key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(real, F.col("component_id")), F.col("doc_id"))).alias("component_id"))


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    Two documents link when 100 * intersection >= percent * union of their
    sets of distinct word n-grams; component_id is the least doc_id that links
    reach. ``percent`` is from 51 to 100.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("key"))
    return _classes(docs, n, percent).drop("key")


def drop_near_duplicates(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each group, that of the least doc_id; all columns kept.

    Rows without words, and rows without doc_id, are groups of their own. Of
    repeated rows one stays; rows that share a doc_id are told apart by their text.
    """
    key = F.xxhash64(F.col("text").cast("string"))
    classes = materialize(_classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key")), n, percent), "decided")
    gone = classes.where("doc_id != component_id").select("doc_id", "key").distinct()
    # the row as one value, so that its columns can't clash
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(gone.hint("shuffle_hash"), ["doc_id", "key"], "left_anti")
    twice = classes.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.isEmpty():
        first = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", "key").alias("row")).select("row")
        kept = kept.join(twice, "doc_id", "left_anti").select("row").union(first)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
