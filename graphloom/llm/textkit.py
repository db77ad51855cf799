"""Vectorised text work on Arrow string batches: bytes, words, hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE, SALT = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
#: Texts are worked on in slices of at most so many bytes (a longer one alone).
SLICE = 1 << 21

_pow: dict[str, np.ndarray] = {}


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string (or binary) array end to end, and len + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    if not len(col) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges with at most ``limit`` bytes each, or one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if "p" not in _pow or len(_pow["p"]) < n:
        m = 1 << max(16, n.bit_length())
        for k, b in (("p", BASE), ("q", pow(BASE, -1, 1 << 64))):
            a = np.full(m, b, U64)
            a[0] = 1
            _pow[k] = np.cumprod(a, dtype=U64)
    return _pow["p"][:n], _pow["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums for ``span_hash``."""
    p = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[0], out=p[1:])
    return p


def span_hash(pre: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [s, e): equal bytes, equal hash."""
    q = powers(len(pre))[1]
    return mix((pre[e] - pre[s]) * q[s] + (e - s).astype(U64) * U64(SALT))


WORD = np.zeros(256, bool)
WORD[128:] = True
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    WORD[_c] = True


def spans(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``flag`` that don't cross rows."""
    n = len(flag)
    prev = np.zeros(n, bool)
    prev[1:] = flag[:-1]
    starts = off[:-1][off[:-1] < n]
    prev[starts] = False
    nxt = np.zeros(n, bool)
    nxt[:-1] = flag[1:]
    ends = off[1:][off[1:] > 0] - 1
    nxt[ends] = False
    return np.flatnonzero(flag & ~prev), np.flatnonzero(flag & ~nxt) + 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, and len + 1 offsets of rows in words, and word starts.

    A word is a maximal run of ASCII letters and digits and non-ASCII characters;
    callers lower-case the text before.
    """
    s, e = spans(WORD[data], off)
    return span_hash(prefix(data), s, e), np.searchsorted(s, off), s


def shingles(w: np.ndarray, woff: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles, and len + 1 offsets of rows in them.

    A row with fewer than n words, but some, has one shingle of all of them.
    """
    count = np.diff(woff)
    have = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    soff = np.concatenate([[0], np.cumsum(have)])
    if not soff[-1]:
        return np.zeros(0, U64), soff
    row = np.repeat(np.arange(len(count)), have)
    at = woff[row] + (np.arange(soff[-1]) - soff[row])
    last = woff[row + 1] - 1
    h = np.zeros(len(at), U64)
    for k in range(n):
        i = at + k
        h = mix(h * U64(BASE) + np.where(i <= last, w[np.minimum(i, len(w) - 1)], U64(0)))
    return h, soff
