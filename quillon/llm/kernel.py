"""Numpy work on the bytes of an Arrow string column: words, their hashes, and hashes of runs of them.

All hashes are 64-bit. A run's hash is a polynomial over hashed symbols, so that any run's hash follows
from two prefix sums; two different runs of the sizes used here agree by chance once in about 2**60 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


SYMBOL = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(m, base, U64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Sums of symbol * BASE**i over prefixes; symbols: 64-bit values."""
    up, _ = powers(len(symbols))
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * up[: len(symbols)], out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run [start, end) of the symbols behind ``sums``."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (np.asarray(end) - np.asarray(start)).astype(U64) * U64(0xD6E8FEB86659FD93))


def byte_class(separators: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


#: Words of the contracts: everything but blank and 0x09 to 0x0D. LETTERS: ASCII letters and digits and all bytes beyond ASCII.
WORDS = byte_class(b" \t\n\v\f\r")
LETTERS = byte_class(bytes(i for i in range(128) if not chr(i).isalnum()))
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


class Texts:
    """Some rows' texts: ``data`` (bytes, one after another) and ``offsets``; row i of the batch is ``first + i``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, keep: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and the index of each row's first word (one more entry than rows)."""
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = keep[self.data]
        opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edge = self.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        opens[edge] = inside[edge + 1]
        closes[edge - 1] = inside[edge]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return start, end, np.searchsorted(start, self.offsets)

    def sums(self, lower: np.ndarray = SAME) -> np.ndarray:
        return prefix_sums(SYMBOL[lower[self.data]])

    def word_hashes(self, keep: np.ndarray = WORDS, lower: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each word's hash, byte start and end, and the index of each row's first word."""
        start, end, first = self.words(keep)
        return run_hash(self.sums(lower), start, end), start, end, first

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts(column: pa.Array, most: int = 1 << 20) -> Iterator[Texts]:
    """The column in pieces of at most ``most`` bytes, or one longer text; null texts are empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def within(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of all runs of ``size`` words that stay in one row; first: as from ``words``."""
    total = int(first[-1])
    fits = np.zeros(total + 1, np.int64)
    last = first[1:] - size + 1
    ok = last > first[:-1]
    np.add.at(fits, first[:-1][ok], 1)
    np.add.at(fits, last[ok], -1)
    return np.flatnonzero(np.cumsum(fits[:-1]) > 0)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))

