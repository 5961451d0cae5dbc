"""Word hashing on Arrow buffers, shared by the text operators.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. Those bytes
never occur inside a multi-byte UTF-8 character, so splitting bytes equals
splitting code points. Word hashes come from prefix sums of a polynomial over
the bytes (mod 2**64) followed by a mixing step, hence cost no Python loop
over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers = {m: np.ones(1, np.uint64) for m in (_MULT, _INV)}


def powers(mult: int, n: int) -> np.ndarray:
    """mult**0 .. mult**(n-1) mod 2**64, grown by doubling."""
    p = _powers.setdefault(mult, np.ones(1, np.uint64))
    while len(p) < n:
        step = U64(pow(mult, len(p), 1 << 64))
        p = np.concatenate([p, p * step])
    if len(p) <= 1 << 20:
        _powers[mult] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in a byte array."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash for each word; ``lower`` folds A-Z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * powers(_MULT, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INV, len(data))[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int, mult: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit hash for each run of n words (empty if fewer)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * U64(mult) + words[k : len(words) - n + 1 + k]
    return mix(out)


def span_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``values[lo:hi]``."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_MULT, len(values)), out=total[1:])
    return mix((total[hi] - total[lo]) * powers(_INV, len(values))[lo] + (hi - lo).astype(np.uint64))


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each value as uint8 views; nulls give no bytes."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from texts(chunk)
        return
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]] if valid is None or valid[i] else data[:0]


def parts(batch: pa.RecordBatch, column: str = "text", rows: int = 512, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows and ``most_bytes`` of text (one text may have more)."""
    ends = np.cumsum([len(data) for data in texts(batch.column(batch.schema.get_field_index(column)))], dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def each(batches: Iterator[pa.RecordBatch], column: str = "text", key: str = "doc_id") -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and texts in small lists: at most 512 rows and 4 MB of text each (one text may have more)."""
    for batch in batches:
        for part in parts(batch, column):
            yield part.column(part.schema.get_field_index(key)).to_pylist(), list(texts(part.column(part.schema.get_field_index(column))))


def to_signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
