"""Sharding, filter audit and conversation repair against brute force, and the cases their docstrings define."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from corvid.llm import conversation_repair as R
from corvid.llm import filter_audit, sharding

RND = random.Random(11)
SCHEMA = "doc_id long, text string, source string, lang string, size string, key int, digest string, part string, mask int, row string, place int, bucket int, copies int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "en", "x", 1, "y", "p", 2, "r", 3, 4, 5) for d, t, s in rows], SCHEMA)


def documents():
    rows = [(i, " ".join(RND.choice("ab cd ef gh ij".split()) for _ in range(RND.randint(0, 300))), RND.choice(["s0", "s0", "s0", "s1", "s2", None])) for i in range(150)]
    rows += [(200 + i, RND.choice(["same text", "same text", "same tëxt", "A B C", ""]), "s1") for i in range(40)]
    rows += [(300, None, "s3"), (301, None, None), (None, "same text", "s0"), (None, None, None), (5, rows[5][1], rows[5][2]), (400, "x" * 40_000 + "a", "s0"), (401, "x" * 40_000 + "b", "s0"), (402, "x" * 40_000 + "a", "s4")]
    return rows + rows[:7]


# --- sharding ---


def test_shards(spark):
    rows = documents()
    got = sharding.assign(frame(spark, rows), shards=8).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert collections.Counter((r.doc_id, r.source, r.size, r.text_crc32) for r in got) == collections.Counter((d, s or "", size(t), zlib.crc32((t or "").encode())) for d, t, s in rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(8)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    # each shard has each source's share, to a row or two at each cut
    for source, n in collections.Counter(s or "" for _, _, s in rows).items():
        for k in range(8):
            assert abs(sum(r.shard == k and r.source == source for r in got) - n / 8) <= 2
    # and brute force agrees
    key = lambda r: ("" if r.doc_id is None else str(r.doc_id), r.size, r.text_crc32)
    part = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:13], 16)
    by_source = collections.defaultdict(list)
    for r in got:
        by_source[r.source].append((part(":".join(["17", *map(str, key(r))])), -1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32))
    order = sorted(((k + part("17:" + s) / 2.0**52) / len(own), s, k, row[1:]) for s, own in by_source.items() for k, row in enumerate(sorted(own)))
    want = collections.Counter()
    for place, (_, s, _, (d, n, crc)) in enumerate(order):
        shard = place * 8 // len(order)
        want[None if d == -1 else d, s, n, crc, shard, place - -(-shard * len(order) // 8)] += 1
    assert want == collections.Counter((r.doc_id, r.source, r.size, r.text_crc32, r.shard, r.slot) for r in got)


def test_shards_of_odd_tables(spark):
    assert sharding.assign(frame(spark, documents()).limit(0)).count() == 0
    few = sharding.assign(frame(spark, [(1, "a", "s"), (2, None, None), (3, "b", "t")]), shards=8).collect()
    assert len({r.shard for r in few}) == 3 and all(r.slot == 0 for r in few)
    # a row repeated more often than a piece, and each row with a source of its own
    hot = sharding.assign(frame(spark, [(None, "a", "s")] * 9000 + [(i, "b", f"t{i}") for i in range(1000)]), shards=3).collect()
    shards = collections.Counter(r.shard for r in hot)
    assert sorted(shards.values()) == [3333, 3333, 3334] and len({(r.shard, r.slot) for r in hot}) == 10_000
    assert all(abs(sum(r.shard == k and r.source != "s" for r in hot) - 333) < 60 for k in range(3))
    with pytest.raises(ValueError):
        sharding.assign(frame(spark, []), shards=0)


def test_shards_written(spark, tmp_path):
    rows = documents()
    sharding.write(frame(spark, rows), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert collections.Counter((r.doc_id, r.text, r.source) for r in back.collect()) == collections.Counter(rows)
    sizes = sorted(r["count"] for r in back.groupBy("shard").count().collect())
    assert len(sizes) == 4 and sizes[-1] - sizes[0] <= 1


# --- filter audit ---


def brute_audit(rows, labels):
    words = {t: re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows}
    fails = []
    for d, t, s in rows:
        t, w = t or "", words[t]
        n = len(t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * n, "D": bool(re.search(r"[#$%&*|]", t))}
        own["E"] = d is not None and any(x is not None and x < d and (u or "") == t for x, u, _ in rows)
        fails.append((s or "", own, *labels.get(d, (0, 0))))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in left if f[1][x]]
                kept = [f for f in left if not f[1][x]]
                row = [len(kept), len(gone), sum(f[1][x] for f in mine) - len(gone), sum(f[1][x] and sum(f[1].values()) == 1 for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                out[part, "".join(order), step] = (x, row)
                total[x] += len(gone)
                left = kept
        for key in [k for k in out if k[0] == part]:
            out[key] = (*out[key][1], total[out[key][0]])
    return out


def test_audit(spark):
    rows = documents()
    labels = {i: (i % 2, int(i % 3 == 0)) for i in range(0, 250, 2)}
    table = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()] + [(4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame(spark, rows), table).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in got} == brute_audit(rows, labels)
    assert len(got) == len({(s or "") for _, _, s in rows}) * 600


@pytest.mark.parametrize("bits", [64, 3])
def test_later_copies(spark, bits):
    """With 3 bits of a hash most classes hold different texts; the texts settle it."""
    rows = documents()
    want = collections.Counter((d, t, s) for d, t, s in rows if d is not None and any(x is not None and x < d and (u or "") == (t or "") for x, u, _ in rows))
    got = filter_audit.later_copies(frame(spark, rows), bits=bits)
    assert got.columns == SCHEMA.replace(",", "").split()[::2]
    assert collections.Counter((r.doc_id, r.text, r.source) for r in got.collect()) == want


def test_audit_of_no_rows(spark):
    empty = frame(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.later_copies(empty).count() == 0
    assert filter_audit.audit(frame(spark, [(1, "a", None)]), labels).count() == 600


# --- conversation repair ---


def brute_edits(rows):
    """All edits of a few rows, with one insert at most in each gap, and at the end."""
    best = None
    for inserts in itertools.product(*[["", "u", "a", "ua"]] * (len(rows) + 1)):
        base = 5 * sum(map(len, inserts))
        if best and base > best[0]:
            continue
        for edits in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, f in rows]):
            cost, audit, roles = base, "", ""
            for (role, fault), edit, put in zip(rows, edits, inserts, strict=False):
                audit += "I" * len(put) + edit[0]
                roles += put + {"D": "", "K": role[:1] or "?", "Ru": "u", "Ra": "a"}[edit]
                cost += {"D": 2, "K": 0}.get(edit, 1) + (5 if edit != "D" and fault == "truncated" else 0)
            audit, roles = audit + "I" * len(inserts[-1]), roles + inserts[-1]
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, roles
    return best


def symbol(role, fault):
    known = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return "x" if fault in ("blank", "duplicate") else known.upper() if fault == "truncated" else known


def test_edits():
    trie = R.Trie()
    cases = [c for n in range(4) for c in itertools.product("suaoSUAOx", repeat=n)]
    cases += [tuple(RND.choice("suaoSUAxuuaa") for _ in range(4)) for _ in range(60)]
    for case in sorted(set(cases)):
        rows = [({"o": "tool", "x": "user"}.get(c.lower(), c.lower()), "blank" if c == "x" else "truncated" if c.isupper() else "") for c in case]
        assert trie.insert("".join(case)) == brute_edits(rows)[:2], case
    assert trie.made < sum(len(c) for c in set(cases)) / 2  # prefixes are shared
    assert R.Trie().insert("uua") == (2, "DKK") and R.Trie().insert("") == (0, "")
    cost, audit = R.Trie().insert("ua" * 50_000 + "u")
    assert cost == 2 and len(audit) == 100_001


def turns():
    out = []
    for conv in [*range(60), None]:
        n = RND.randint(0, 4) if conv != 7 else 0
        for turn in range(n):
            out.append((conv, None if RND.random() < 0.1 else turn * RND.choice([1, 1, 2]), RND.choice(["user", "assistant", "system", "tool", "", None]), RND.choice(["Yes.", "No", "Why?", " \n\t", "", None, "Tail. \n", "Ends with é"])))
    return out + [(90, 0, "user", "Hi."), (90, 0, "user", "Hi."), (90, 0, "assistant", "Hi!")]


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (1 + (kind == 3))
    return out


def brute_repair(rows, conversations):
    found = {}
    for conv in conversations:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, roles = brute_edits([(r, f) for (_, r, _), f in zip(own, faults, strict=True)])
        at, out, final = 0, [], iter(roles)
        for letter in audit:
            if letter != "I":
                _, role, text = own[at]
                at += 1
            if letter != "D":
                to = next(final)
                out.append(("" if letter == "I" else text, role if letter == "K" else {"u": "user", "a": "assistant"}[to]))
        text = "\n".join(f"{r}:{t}" for t, r in out)
        found[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def test_repair(spark):
    rows = [r for r in turns() if sum(x[0] == r[0] for x in brute_damage([r])) is not None]
    table = spark.createDataFrame([(*r, "extra", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, place string, symbol int, audit string")
    damaged = brute_damage(rows)
    assert collections.Counter(map(tuple, R.damage(table).collect())) == collections.Counter(damaged)
    want = brute_repair(damaged, {r[0] for r in rows})
    got = R.repair_digests(R.damage(table), table).collect()
    assert {r.conv_id: tuple(r[1:]) for r in got} == want and len(got) == len(want)
    # the repaired rows themselves give the same digests
    texts = collections.defaultdict(list)
    for r in R.repair(R.damage(table)).collect():
        texts[r.conv_id].append((r.place, f"{r.role}:{r.text}"))
    for conv, (*_, digest) in want.items():
        own = sorted(texts[conv])
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert hashlib.sha256("\n".join(t for _, t in own).encode()).hexdigest() == digest


def test_repair_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert R.repair_digests(empty).count() == 0 and R.repair(empty).count() == 0
    alone = R.repair_digests(empty, spark.createDataFrame([(3, None, None, None)], schema)).first()
    assert tuple(alone) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    long = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"{i}" + "x" * 100 + ".") for i in range(3000)], schema)
    row = R.repair_digests(long).first()
    assert row.cost == 0 and row.audit == "K" * 3000 and row.gaps == 0
