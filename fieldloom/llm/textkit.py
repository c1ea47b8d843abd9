"""Vectorised text primitives over Arrow string buffers.

Every operator of this subpackage that has to look at words does so through these
functions: they work on the raw UTF-8 bytes of an Arrow column (no Python string per
row), find the words, and hash each word with one pass of prefix sums.

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased for hashing.
Null texts count as empty texts.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one step works on, so that all its arrays stay small.
CHUNK_BYTES = 1 << 20
#: Bytes that share one table of powers.
SEGMENT_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_IS_PUNCT = np.zeros(256, bool)
_IS_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), element-wise."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0xD1342543DE82EF95))
_LOWER_VALUE = _BYTE_VALUE[_LOWER]


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i in 0..n."""
    up, down = np.full(n + 1, _BASE, U64), np.full(n + 1, pow(_BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 12, 1 << (n - 1).bit_length() if n > 1 else 1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets (int64, from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``limit`` bytes; a row is never cut."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """The words of some rows: ``starts`` and ``ends`` (byte positions), ``first`` (index of each row's first word, and the total last)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        stops = solid.copy()
        stops[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def trim(self) -> Words:
        """Leave out ASCII punctuation at both ends of each word that has something else."""
        solid = np.flatnonzero(~_IS_PUNCT[self.data])
        if len(solid) and len(self):
            a, b = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends) - 1
            some = a <= b
            self.starts[some], self.ends[some] = solid[a[some]], solid[b[some]] + 1
        return self

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self), U64)
        table = _LOWER_VALUE if lower else _BYTE_VALUE
        a = 0
        while a < len(self):
            base = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, base + SEGMENT_BYTES, "right")))
            piece = table[self.data[base : self.ends[b - 1]]]
            up, down = powers(len(piece))
            sums = np.zeros(len(piece) + 1, U64)
            np.cumsum(piece * up[: len(piece)], out=sums[1:])
            s, e = self.starts[a:b] - base, self.ends[a:b] - base
            out[a:b] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xA0761D6478BD642F)
            a = b
        return mix(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive word hashes; with fewer words, of them all as one; without, nothing."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    out = np.full(n - size + 1, size, U64)
    for i in range(size):
        out = (out + words[i : n - size + 1 + i]) * U64(0x9FB21C651E98DF25 + 2 * i)
        out ^= out >> U64(29)
    return mix(out)


def runs(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range [begin, end) of word hashes, equal for equal runs wherever they stand."""
    up, down = powers(len(words))
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
