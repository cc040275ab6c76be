"""Vectorised text primitives over Arrow string buffers (numpy, no per-character Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_LUT = np.random.Generator(np.random.Philox(20260101)).integers(1, 2**64, 256, dtype=U64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW = {"p": np.ones(1, U64), "q": np.ones(1, U64)}
CHUNK = 1 << 20
SMALL = 1 << 18  # where a chunk takes some hundred bytes of memory for each byte of text


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i below n."""
    if len(_POW["p"]) < n:
        m = max(n, CHUNK + 1)
        for k, r in (("p", _R), ("q", _RINV)):
            x = np.full(m, r, U64)
            x[0] = 1
            _POW[k] = np.cumprod(x)
    return _POW["p"], _POW["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offs


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def span_hash(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, lut: np.ndarray = _LUT) -> np.ndarray:
    """64-bit hash of each byte span of ``b``, independent of where the span lies."""
    p, q = powers(len(b) + 1)
    acc = np.empty(len(b) + 1, U64)
    acc[0] = 0
    np.cumsum(lut[b] * p[: len(b)], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * q[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def spans(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true, broken at the positions ``cuts``."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = mask[1:] != mask[:-1]
    edge[0] = edge[n] = True
    edge[cuts] = True
    at = np.flatnonzero(edge)
    s, e = at[:-1], at[1:]
    keep = mask[s]
    return s[keep], e[keep]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True


def words(data: np.ndarray, offs: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row of a chunk: (bytes lower-cased for A-Z, starts, ends, row of each, hash of each).

    A word is a run of bytes that are not space, tab, LF, VT, FF or CR; with ``alnum`` a run of
    ASCII letters, digits and non-ASCII bytes. Positions count from the chunk's first byte.
    """
    b = _LOWER[data[offs[0] : offs[-1]]]
    rel = offs - offs[0]
    s, e = spans(_ALNUM[b] if alnum else ~_SPACE[b], rel[rel < len(b)])
    row = np.searchsorted(rel, s, "right") - 1
    return b, s, e, row, span_hash(b, s, e)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start+len."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lens > 0
    starts, lens = starts[keep].astype(np.int64), lens[keep].astype(np.int64)
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lens)[:-1]
    step[at] = starts[1:] - starts[:-1] - lens[:-1] + 1
    return np.cumsum(step)
