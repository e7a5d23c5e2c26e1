"""Words of Arrow text columns as 64-bit hashes, by array operations over the UTF-8 bytes.

A word is a run of bytes other than the separators 0x20 and 0x09-0x0D, which is the same as
splitting the decoded text, because no multi-byte character holds such a byte.  A word's hash is
a polynomial over a fixed random value per byte, modulo 2**64, passed through a bijective mixer;
hashes of word windows are built the same way from word hashes.  Two given words (or windows)
share a hash with a probability of about 2**-63; where that matters callers check the rest.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000  # text handled at once; bounds the scratch memory of a task
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so both have inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
# Letters, digits and every byte of a multi-byte character.
_IS_PLAIN = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.bases = (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = 1 << max(12, (n - 1).bit_length())
            for i, base in enumerate(self.bases):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                self.tables[i] = np.multiply.accumulate(table)
        return self.tables


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def _release() -> None:
    """Give freed memory back; where the C library has no such call, it stays with the process."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@dataclass
class Words:
    """Words of consecutive rows; row ``r`` holds words ``first[r]`` to ``first[r + 1] - 1``."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


@dataclass
class Windows:
    """Windows of ``width`` words within one row each; ``first`` counts windows per row."""

    hashes: np.ndarray
    first: np.ndarray
    at: np.ndarray  # number of the window's first word

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, width)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends.astype(np.int64) - int(ends[0])


def row_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each; a longer text stands alone, whole.

    After the last range the scratch memory goes back to the system, so that what one batch
    needed does not stay with a worker for good.
    """
    offsets = text_bytes(column)[1]
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(max(high, low + 1), rows, low + 65_535)
        yield low, high
        low = high
    _release()


def span_hashes(data: np.ndarray, low: np.ndarray, high: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the byte spans from ``low`` to before ``high``."""
    powers, inverse = _BYTES.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[lower][data] * powers[: len(data)], out=sums[1:])
    return mix((sums[high] - sums[low]) * inverse[low])


def split(column: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """Words of every row, unchanged or with A-Z in lower case.

    ``plain``: ASCII punctuation and control characters separate words too.
    """
    data, offsets = text_bytes(column)
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none, data)
    inside = (_IS_PLAIN if plain else _IS_WORD)[data]
    row_starts = offsets[:-1][offsets[:-1] < size]
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    before[row_starts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    after[row_starts[row_starts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(span_hashes(data, starts, ends, lower), np.searchsorted(starts, offsets), starts, ends, data)


def windows(words: Words, width: int, short: bool = False) -> Windows:
    """Windows of ``width`` consecutive words of one row.

    ``short``: a row with 1 to ``width - 1`` words has one window of all its words.
    """
    counts = words.counts
    number = np.maximum(counts - width + 1, 0)
    length = np.full(len(counts), width)
    if short:
        few = (counts > 0) & (counts < width)
        number[few], length[few] = 1, counts[few]
    first = np.concatenate([[0], np.cumsum(number)])
    at = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], number)
    n = len(words.hashes)
    powers, inverse = _WORDS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hashes * powers[:n], out=sums[1:])
    stop = at + (np.repeat(length, number) if short else width)
    return Windows(mix((sums[stop] - sums[at]) * inverse[at]), first, at)


def unique_per_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the row offsets into them."""
    order = np.argsort(values)
    order = order[np.argsort(rows[order].astype(np.uint16 if n_rows <= 1 << 16 else np.int64), kind="stable")]
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], np.searchsorted(rows[new], np.arange(n_rows + 1))
