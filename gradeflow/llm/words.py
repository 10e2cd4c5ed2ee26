"""Words of a batch of texts as 64-bit hashes, without a Python loop per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  These separators are
ASCII, so the bytes of UTF-8 are cut at the same places as the characters.
Hashes of ranges (a word's bytes, a window's words) are differences of prefix
sums modulo 2**64 times a power, finished by a mixing step.  Two different
ranges share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa

SLICE = 1 << 19  # bytes hashed at a time, so that the prefix sums stay in cache

_BYTE_BASE = 0xD6E8FEB86659FD93
_WORD_BASE = 0x9FB21C651E98DF25


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(29)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n (base is odd)."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Words:
    """``hash`` (uint64), ``doc`` (row number) of every word in order; ``first``
    holds the index of each row's first word, with the total at the end.
    ``start`` and ``end`` are byte positions in ``data``."""

    def __init__(self, column, lower: bool = False):
        data, offsets = text_bytes(column)
        self.data, self.offsets = data, offsets
        gap = np.zeros(256, dtype=bool)
        gap[[32, 9, 10, 11, 12, 13]] = True
        inside = ~gap[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True  # a row's first byte begins a word even if the byte before is none
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.lower = lower

    @cached_property
    def hash(self) -> np.ndarray:
        value = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if self.lower:
            value[65:91] = value[97:123]
        out = np.empty(len(self.start), dtype=np.uint64)
        i = 0
        longest = int((self.end - self.start).max()) if len(self.start) else 0
        up, down = powers(_BYTE_BASE, SLICE + longest)
        while i < len(out):
            a = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, a + SLICE, side="right")))
            b = self.end[j - 1]
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(value[self.data[a:b]] * up[: b - a], out=sums[1:])
            s, e = self.start[i:j] - a, self.end[i:j] - a
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
        return out


class Ranges:
    """Hashes of any run of words from one pair of prefix sums."""

    def __init__(self, word_hash: np.ndarray):
        self.n = len(word_hash)
        up, self.down = powers(_WORD_BASE, self.n)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(word_hash * up[: self.n], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on (n - k + 1 of them)."""
        if self.n < k:
            return np.empty(0, dtype=np.uint64)
        g = (self.sums[k:] - self.sums[:-k]) * self.down[: self.n - k + 1]
        return mix(g + np.uint64(k))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words start..end-1; equal to ``grams`` for equal lengths."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and each row's offset (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offs, body = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 2 << 20):
    """Slices of a batch with about ``limit`` bytes of text each, or one row."""
    if not batch.num_rows:
        return
    column = batch.column(text)
    if pa.types.is_null(column.type):
        yield batch
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
