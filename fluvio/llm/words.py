"""Vectorised word and shingle hashing over Arrow binary columns, and packed integer blocks.

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.
A word's 64-bit hash is a polynomial over random byte values, mixed with its
length, so a batch of texts is hashed with a handful of numpy passes and no
Python object for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array; a null has no bytes."""
    if col.null_count:
        col = col.fill_null(b"")
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32, count=len(col) + 1 + col.offset)
    off = off[col.offset:].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte of every word; index of each text's first word, with a last entry)."""
    if len(data) == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(off), dtype=np.int64)
    word = ~_WHITE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word; index of each text's first word, with a last entry)."""
    data, off = buffers(col)
    start, end, at = spans(data, off)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h ^= (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    return mix(h), at


def shingles(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-word shingle hashes of every text, sorted within it; index of each text's first, with a last entry).

    A text of fewer than ``n`` words has its whole sequence as one shingle; one without words has none.
    """
    h, at = word_hashes(col)
    count = np.diff(at)
    k = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate(([0], np.cumsum(k)))
    doc = np.repeat(np.arange(len(count)), k)
    pos = np.arange(first[-1]) - first[doc] + at[doc]
    length = np.minimum(count[doc], n)
    out = np.zeros(len(pos), dtype=np.uint64)
    for j in range(n):
        there = j < length
        out[there] = mix(out[there] * _U(0x9E3779B97F4A7C15) + h[pos[there] + j])
    sets = [np.unique(out[a:b]) for a, b in zip(first[:-1], first[1:])]
    return (np.concatenate(sets) if sets else out), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def pack(a: np.ndarray) -> bytes:
    """An unsigned integer array as zstd-compressed byte planes (repeated high bytes cost next to nothing)."""
    import zstandard

    a = np.ascontiguousarray(a, dtype=np.uint64)
    planes = a.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    """A non-decreasing unsigned array: its differences, packed."""
    a = np.asarray(a, dtype=np.uint64)
    return pack(np.diff(a, prepend=_U(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)
