"""Vectorised hashing of the words of UTF-8 texts, straight on the buffers of an Arrow column.

A text stays bytes throughout. Words are maximal runs of member bytes; all bytes from 0x80 up are members or not
together, so a run never splits a character. Every function works on a chunk of about ``CHUNK`` bytes, or on a single
longer text, which is hashed piece by piece: memory is bounded by the chunk or, for a long text, by its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at a time: the arrays made of them, eight bytes for each, stay in a core's cache.
CHUNK = 1 << 17

U64 = np.uint64
_MASK = (1 << 64) - 1


def splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    z = (np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(seed)
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, in place."""
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_BASE = 0x5851F42D4C957F2D | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_POW = _powers(_BASE, CHUNK + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 1)
_BYTE = splitmix(256, 11)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

#: Members of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Members of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Letters: a-z, A-Z and everything beyond ASCII.
LETTER = ALNUM.copy()
LETTER[48:58] = False


def column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off.astype(np.int64)


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with up to ``limit`` bytes, or of one row."""
    raw, off = column(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = member[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hashes of the byte spans, which are in order of their starts and at most overlap, after folding each byte."""
    out = np.empty(len(starts), U64)
    value = _BYTE[fold]
    i = 0
    while i < len(starts):
        base = int(starts[i])
        fits = ends[i:] <= base + CHUNK
        j = i + (len(fits) if fits.all() else int(np.argmin(fits)))
        if j == i:
            piece = fold[data[base : ends[i]]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little")
            i += 1
            continue
        last = int(ends[i:j].max())
        sums = np.zeros(last - base + 1, U64)
        np.cumsum(value[data[base:last]] * _POW[: last - base], dtype=U64, out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        h = (sums[e] - sums[s]) * _INV[s]
        h += (e - s).astype(U64) * U64(0x9E3779B97F4A7C15)
        out[i:j] = mix(h)
        i = j
    return out


class Starts:
    """Hashes of runs from given places, of several lengths over the same bytes: those of ``span_hashes``."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.sums = data, None
        if len(data) <= CHUNK:
            self.sums = np.zeros(len(data) + 1, U64)
            np.cumsum(_BYTE[data] * _POW[: len(data)], dtype=U64, out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.sums is None:
            return span_hashes(self.data, starts, ends, SAME)
        h = (self.sums[ends] - self.sums[starts]) * _INV[starts]
        h += (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)
        return mix(h)


_STEP = splitmix(64, 23) | U64(1)


def grams(w: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` consecutive entries of ``w``, whatever rows they belong to."""
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = w[:n] * _STEP[0]
    for k in range(1, size):
        h += w[k : k + n] * _STEP[k % 64]
    h += U64(size)
    return mix(h)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (size[0] of them), then those of the next."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    heads = np.cumsum(size) - size
    return np.arange(total) - np.repeat(heads - begin, size)


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries: block-wise running minima from both sides, a few passes in all."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    if width == 1:
        return h.copy()
    pad = (-len(h)) % width
    full = np.concatenate([h, np.full(pad, np.iinfo(h.dtype).max, h.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def window_max(h: np.ndarray, width: int) -> np.ndarray:
    return ~window_min(~h, width)


def selected(h: np.ndarray, width: int) -> np.ndarray:
    """Winnowing: the entries that are the minimum of some window of ``width`` entries. Which are selected in a window
    depends on nothing outside it, so equal windows select equal entries."""
    low = window_min(h, width)
    if not len(low):
        return np.zeros(len(h), bool)
    edge = np.zeros(width - 1, h.dtype)
    return window_max(np.concatenate([edge, low, edge]), width) == h
