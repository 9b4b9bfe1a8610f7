"""Words, symbols and hashes of Arrow text columns, for whole batches at once.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are
polynomials modulo 2**64 over random symbol values, so the hash of any span is
a difference of two prefix sums; `mix` spreads the result over all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Spans:
    """Hashes of spans [start, end) of a symbol array."""

    def __init__(self, symbols: np.ndarray):
        up, self._down = powers(len(symbols) + 1)
        self._sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * up[: len(symbols)], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k symbols from each position that has them."""
        n = len(self._sums) - k
        return mix((self._sums[k:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, U64)


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of at most `most_bytes` of text each, or of one row."""
    for batch in batches:
        ends = text_of(batch)[1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    # The worker may wait for other tasks; it need not keep what this one used.
    pa.default_memory_pool().release_unused()


def text_of(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows in them; a null is empty."""
    array = batch.column(column)
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_large_binary(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = array.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets * 0
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Word positions of a batch: word i is data[starts[i]:ends[i]]; row r has
    the words rows[r] to rows[r + 1] - 1. `breaks` are the bytes between words."""

    def __init__(
        self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = _SPACE
    ):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        inside = ~breaks[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.rows = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return Spans(byte_symbols(self.data)).hashes(self.starts, self.ends)


def not_letters() -> np.ndarray:
    """Bytes that end a word if only ASCII letters and other scripts form words."""
    breaks = np.ones(256, bool)
    breaks[65:91] = breaks[97:123] = breaks[128:] = False
    return breaks


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def row_of(rows: np.ndarray) -> np.ndarray:
    """The row of each item, from the offsets of the rows."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
