"""Vectorised words and shingle hashes over Arrow text columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as a run of
characters other than those. Word hashes are polynomials over the bytes modulo 2**64, taken from
one prefix sum over a block of text, so that no Python object is made for any word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BLOCK = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different seeds give independent hashes."""
    x = x + U((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) % 2**64)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hasher:
    """Word hashes of text columns; ``fold`` lower-cases A-Z first."""

    def __init__(self, fold: bool = False) -> None:
        byte = np.arange(256)
        if fold:
            byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        self.of_byte = mix(byte.astype(U), 1)
        self.is_space = np.isin(np.arange(256), SPACES)
        self.pow, self.inv = powers(BLOCK + 1)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, offsets of each row's words). Null rows have no words."""
        data, offsets = raw(column)
        first, last = int(offsets[0]), int(offsets[-1])
        hashes, starts, at = [], [], first
        while at < last:
            end = self._cut(data, offsets, at, last)
            h, s = self._block(data[at:end], offsets, at)
            hashes.append(h)
            starts.append(s)
            at = end
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        return np.concatenate(hashes) if hashes else np.zeros(0, U), np.searchsorted(starts, offsets)

    def _cut(self, data: np.ndarray, offsets: np.ndarray, at: int, last: int) -> int:
        """The end of a block: no word crosses it."""
        size = BLOCK
        while at + size < last:
            row = int(offsets[np.searchsorted(offsets, at + size, "right") - 1])
            space = np.flatnonzero(self.is_space[data[at : at + size]])
            end = max(row, at + int(space[-1]) + 1 if len(space) else at)
            if end > at:
                return end
            size *= 2
        return last

    def _block(self, block: np.ndarray, offsets: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(block)
        if n >= len(self.pow):
            pw, inv = powers(n + 1)
        else:
            pw, inv = self.pow, self.inv
        word = ~self.is_space[block]
        new_row = np.zeros(n + 1, bool)
        new_row[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + n)] - at] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | new_row[1:n]
        ends[:-1] &= ~word[1:] | new_row[1:n]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = np.zeros(n + 1, U)
        np.cumsum(self.of_byte[block] * pw[:n], out=sums[1:])
        h = (sums[ends] - sums[begins]) * inv[begins]
        return mix(h + (ends - begins).astype(U) * U(BASE)), begins + at


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of a text column, without copying the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, so that long texts keep memory bounded."""
    if not batch.num_rows:
        return
    _, offsets = raw(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def grams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive words of the whole array (rows not separated)."""
    if len(words) < n:
        return np.zeros(0, U)
    m = len(words) - n + 1
    h = words[:m].copy()
    for i in range(1, n):
        h *= U(BASE)
        h += words[i : i + m]
    return mix(h, seed + n)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
