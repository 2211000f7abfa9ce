"""Vectorised work on the UTF-8 bytes of many texts at once: words, lines, shingles and their hashes.

Every function takes `data` (uint8) and `offs` (int64, one more than texts) of a step of texts; no Python loop
runs over words or characters. Hashes are 64-bit polynomials of random byte values, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from accordis.llm.shared import STEP_BYTES

U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


BYTE = _splitmix(256, 7) | U(1)
LANE = _splitmix(64, 99) | U(1)
MUL = U(0xD6E8FEB86659FD93)
INV = U(pow(int(MUL), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((MUL, INV)):
            p = np.full(max(n, STEP_BYTES + 1024), base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(29))
    h = h * U(0x9FB21C651E98DF25)
    return h ^ (h >> U(32))


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of pieces of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, o, d = column.buffers()
    offs = np.frombuffer(o, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def within(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of mask in each range between neighbouring offs."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, and each text's first word with one more entry at the end."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = ~space[data]
    edge = offs[(offs > 0) & (offs < n)]
    a = inside[1:] & ~inside[:-1]
    z = inside[:-1] & ~inside[1:]
    both = edge[inside[edge] & inside[edge + 1]]
    a[both] = z[both] = True
    starts, ends = np.flatnonzero(a), np.flatnonzero(z)
    return starts, ends, np.searchsorted(starts, offs)


def prefix(data: np.ndarray) -> np.ndarray:
    p, _ = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * p[: len(data)], out=s[1:])
    return s


def spans_hash(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, from prefix()."""
    _, inv = powers(len(s))
    return mix((s[ends] - s[starts]) * inv[starts])


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k neighbouring words of one text and the index of each one's text; short texts have none here."""
    n, doc = len(h), np.repeat(np.arange(len(first) - 1), np.diff(first))
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = np.zeros(n - k + 1, U)
    for i in range(k):
        g += h[i : n - k + 1 + i] * LANE[i]
    ok = doc[: n - k + 1] == doc[k - 1 :]
    return mix(g[ok]), doc[: n - k + 1][ok]


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """grams(), and for a text of 1 to k - 1 words its whole sequence as one shingle; in order of texts."""
    g, doc = grams(h, first, k)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        s = np.zeros(len(short), U)
        for i in range(k - 1):
            has = count[short] > i
            s[has] += h[first[short[has]] + i] * LANE[i]
        g, doc = np.concatenate([g, mix(s + U(k) * LANE[60] + count[short].astype(U))]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    return g, doc


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, with one more entry."""
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=c[1:])
    return c
