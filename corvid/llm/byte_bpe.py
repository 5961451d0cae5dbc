"""Byte-level BPE encoding and decoding.

Pre-tokenisation needs no regular expression: each code point gets a class
from a table, and an automaton of eight states reads the classes. A class is a
function from state to state; composing functions is associative, so the state
before every character comes from a blocked scan over arrays: the functions of
64 characters are composed for all blocks at once, the blocks' functions by
doubling, and the characters inside the blocks in 64 vector steps. The state
and the next character's class tell whether a token starts. The slices found
are merged by rank with a cache, and their byte offsets are kept.

Nulls encode as the empty text; there is nothing to drop for long texts. Ids
are returned as little-endian unsigned 32-bit integers in binary, which is
what token stores hold; offsets are byte positions of pre-tokens.
Lone surrogates can't occur in Spark strings. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

LETTER, NUMBER, OTHER, BLANK, WHITE, APOS1, APOS2, RESET = range(8)
# states: nothing before or a contraction ended; in letters; numbers; others; white ending in a blank; white ending otherwise; one or two letters of a contraction to come
_FREE, _L, _N, _O, _B, _W, _C1, _C2 = range(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    to = np.zeros((8, 8), np.uint8)
    start = np.zeros((8, 8), bool)
    for state in range(8):
        for cls, own in ((LETTER, _L), (NUMBER, _N), (OTHER, _O)):
            to[cls, state] = own
            start[cls, state] = state not in (own, _B)
        for cls, pending in ((APOS1, _C1), (APOS2, _C2)):
            absorbed = state in (_O, _B)
            to[cls, state] = _O if absorbed else pending
            start[cls, state] = not absorbed
        to[BLANK, state], to[WHITE, state] = _B, _W
        start[BLANK, state] = start[WHITE, state] = state not in (_B, _W)
        to[RESET, state] = _FREE
    to[LETTER, _C1], to[LETTER, _C2] = _FREE, _C1
    start[LETTER, _C1] = start[LETTER, _C2] = False
    return to, start


_TO, _START = _tables()
_ASCII_WHITE = {9, 10, 11, 12, 13, 32}


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point, from the Unicode database."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            out[cp] = LETTER
        elif kind[0] == "N":
            out[cp] = NUMBER
        elif kind[0] == "Z" or cp in _ASCII_WHITE or cp == 0x85:
            out[cp] = WHITE
    out[32] = BLANK
    return out


def token_starts(points: np.ndarray, reset: np.ndarray | None = None) -> np.ndarray:
    """Whether a pre-token starts at each code point; ``reset`` marks separators between texts."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    cls = _classes()[points]
    if reset is not None:
        cls[reset] = RESET
    ahead = np.zeros(n + 2, np.uint32)
    ahead[:n] = points
    if reset is not None:
        ahead[:n][reset] = 0
    one, two = ahead[1 : n + 1], ahead[2 : n + 2]
    quote = (points == 39) & (cls == OTHER)
    if quote.any():
        cls[quote & np.isin(one, [ord(c) for c in "stmd"])] = APOS1
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cls[quote & pair] = APOS2
    width = 64
    blocks = -(-n // width)
    padded = np.full(blocks * width, RESET, np.uint8)
    padded[:n] = cls
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    flat = _TO.ravel()
    maps = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for k in range(width):
        maps = flat[columns[k][:, None].astype(np.uint16) * 8 + maps]
    step = 1
    while step < blocks:  # maps[i] becomes the composition of blocks 0..i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), 1)
        step *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = maps[:-1, _FREE]
    before = np.empty((width, blocks), np.uint8)
    for k in range(width):
        before[k] = state
        state = flat[columns[k].astype(np.uint16) * 8 + state]
    out = _START[cls, before.T.ravel()[:n]]
    # the last of several white characters is a token of its own (or leads the next token), unless the text ends
    white = (cls == BLANK) | (cls == WHITE)
    solid = np.zeros(n, bool)
    solid[:-1] = ~white[1:] & (cls[1:] != RESET)
    return out | white & solid


class Codec:
    """Ranks of a vocabulary with a merging cache of bounded size."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.limit = cache
        self.known: dict[bytes, bytes] = {p: r.to_bytes(4, "little") for p, r in self.ranks.items()}
        self.fixed = len(self.known)
        self.pairs: tuple[np.ndarray, np.ndarray] | None = None

    def merge(self, piece: bytes) -> bytes:
        """Merge the adjacent pair of least rank (the first of equals) until none is left."""
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 64:
            return self._merge_long(parts)
        none = 1 << 60
        costs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while costs:
            low = min(costs)
            if low == none:
                break
            i = costs.index(low)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return b"".join([self.ranks[p].to_bytes(4, "little") for p in parts])

    def _merge_long(self, parts: list[bytes]) -> bytes:
        """The same with a heap and a linked list: n log n for runs without spaces."""
        import heapq

        rank, n = self.ranks.get, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or parts[i] + parts[j] != whole:
                continue
            parts[i], alive[j], after[i] = whole, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := rank(pair := parts[a] + parts[after[a]])) is not None:
                    heapq.heappush(heap, (r, a, pair))
        return b"".join([self.ranks[p].to_bytes(4, "little") for p, ok in zip(parts, alive, strict=True) if ok])

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys ``left << 32 | right`` of the pairs of ids that merge, sorted, with the rank of each."""
        keys, ranks = [], []
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                left, right = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        return np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` for many short pieces at once: in each round every piece merges its least pair."""
        if self.pairs is None:
            self.pairs = self._pairs()
        keys, ranks = self.pairs
        none = np.int64(1 << 60)

        def cost(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            key = left << 32 | right
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, ranks[at], none)

        lens = np.array([len(p) for p in pieces])
        m, width = len(pieces), int(lens.max())
        column = np.arange(width)
        inside = column < lens[:, None]
        ids = np.zeros((m, width + 1), np.int64)
        single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        ids[:, :width][inside] = single[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.minimum(column + 1, lens[:, None]), (m, width)).copy()
        before = np.broadcast_to(column - 1, (m, width)).copy()
        costs = np.full((m, width), none)
        two = column + 1 < lens[:, None]
        costs[two] = cost(ids[:, :width][two], ids[:, 1:][two])
        alive = inside.copy()
        rows = np.arange(m)
        while len(rows):
            p = costs[rows].argmin(1)
            low = costs[rows, p]
            on = low < none
            rows, p, low = rows[on], p[on], low[on]
            if not len(rows):
                break
            q = after[rows, p]
            nxt = after[rows, q]
            ids[rows, p] = low
            alive[rows, q] = False
            costs[rows, q] = none
            after[rows, p] = nxt
            has = nxt < lens[rows]
            r, x, y = rows[has], p[has], nxt[has]
            before[r, y] = x
            costs[rows, p] = none
            costs[r, x] = cost(ids[r, x], ids[r, y])
            prior = before[rows, p]
            has = prior >= 0
            r, x, y = rows[has], prior[has], p[has]
            costs[r, x] = cost(ids[r, x], ids[r, y])
        flat = ids[:, :width][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, pieces: set[bytes]) -> None:
        """Put the ids of new pieces into the cache, which is emptied once it is full."""
        if len(self.known) + len(pieces) > self.limit + self.fixed:
            self.known = dict(itertools.islice(self.known.items(), self.fixed))
        new = sorted(pieces.difference(self.known), key=len)
        short = [p for p in new if len(p) <= 48]
        for lo in range(0, len(short), 8192):
            part = short[lo : lo + 8192]
            self.known.update(zip(part, self.merge_many(part), strict=True))
        self.known.update((p, self.merge(p)) for p in new[len(short) :])

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of each text, given as its pre-tokens."""
        self.learn(set(itertools.chain.from_iterable(texts)))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in texts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def slices(datas: list[np.ndarray]) -> Iterator[tuple[bytes, list[int]]]:
    """For each text its bytes and the byte offsets of its pre-tokens, the end included."""
    raw = [d.tobytes() for d in datas]
    points = np.frombuffer("\n".join([r.decode("utf-8") for r in raw]).encode("utf-32-le"), np.uint32) if raw else np.zeros(0, np.uint32)
    sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    ends = np.cumsum(np.array([len(r) + 1 for r in raw], np.int64))
    reset = np.searchsorted(at, ends[:-1] - 1)
    starts = token_starts(points, reset)
    starts[reset] = False
    offsets = at[:-1][starts]
    cut = np.searchsorted(offsets, ends)
    lo = 0
    for i, r in enumerate(raw):
        first = int(ends[i]) - len(r) - 1
        yield r, (offsets[lo : cut[i]] - first).tolist() + [len(r)]
        lo = cut[i]


def _encode(path: str, digests: bool):
    def run(batches):
        coder = codec(path)
        for batch in batches:
            get = lambda k: batch.column(batch.schema.get_field_index(k))  # noqa: E731, B023
            ids, datas = get("doc_id").to_pylist(), list(T.texts(get("text")))
            lo = 0
            while lo < len(datas):
                hi, size = lo, 0
                while hi < len(datas) and (hi == lo or size + len(datas[hi]) <= 1 << 20) and hi - lo < 256:
                    size += len(datas[hi])
                    hi += 1
                rows = []
                cut = list(slices(datas[lo:hi]))
                pieces = [[raw[a:b] for a, b in zip(cuts, cuts[1:])] for raw, cuts in cut]  # noqa: B905
                for d, (_, cuts), coded in zip(ids[lo:hi], cut, coder.encode(pieces), strict=True):
                    if digests:
                        rows.append((d, len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(coder.decode(coded)).hexdigest()))
                    else:
                        rows.append((d, len(coded) // 4, coded, cuts[:-1]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string()) if digests else (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "offsets"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                lo = hi

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian u32) and offsets (bytes at which pre-tokens start) of each text."""
    return _input(docs).mapInArrow(_encode(path, False), "doc_id long, n_tokens long, ids binary, offsets array<int>")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the bytes decoded from them."""
    return _input(docs).mapInArrow(_encode(path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text (bytes that are no UTF-8 become U+FFFD) from ``ids``."""

    def run(batches):
        coder = codec(path)
        for batch in batches:
            get = lambda k: batch.column(batch.schema.get_field_index(k))  # noqa: E731, B023
            out = [coder.decode(x or b"").decode("utf-8", "replace") for x in get("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([get("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
