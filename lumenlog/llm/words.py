"""Words of whole text columns as numpy arrays, straight from Arrow buffers.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, after lower-casing
A to Z; it never crosses from one text into the next. A null text has no words. Callers feed slices of bounded size (``slices``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; keeps the 64-bit values of a step small.
HASH_BYTES = 1 << 18

_STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a fixed bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(4095, _STEP)]))
#: One over each power of the step (it is odd, so there is one modulo 2 ** 64), for as many bytes as are hashed at a time.
_inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(HASH_BYTES - 1, pow(int(_STEP), -1, 1 << 64), np.uint64)]))


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash step."""
    global _powers
    if n > len(_powers):
        size = max(n, 2 * len(_powers))
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _STEP)]))
    return _powers[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts (one more entry for the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text stands alone."""
    lo = 0
    while lo < len(starts) - 1:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """The words of a slice in order: their text's row, where they lie in ``data`` (lower-cased), and their 64-bit hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray


def words(data: np.ndarray, starts: np.ndarray) -> Words:
    """Words of the texts that ``starts`` cuts ``data`` into."""
    upper = (data - np.uint8(ord("A"))) < 26  # differences of bytes wrap around
    data = data + (upper.view(np.uint8) << np.uint8(5))
    inside = (data != 0x20) & ((data - np.uint8(0x09)) > 4)
    if not inside.any():
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(0, np.uint64))
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[starts[:-1][starts[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[starts[1:][starts[1:] > 0] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.repeat(np.arange(len(starts) - 1), np.diff(np.searchsorted(first, starts)))
    # A word's hash is the sum of its bytes' codes times the step to the power of their places, modulo 2 ** 64; running sums over all
    # bytes give it times the power of where the word starts.
    hashes, lo = np.empty(len(first), np.uint64), 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(last, first[lo] + HASH_BYTES, "right")))
        begin, end = first[lo:hi] - first[lo], last[lo:hi] - first[lo]
        codes = _BYTE_CODE[data[first[lo] : last[hi - 1]]]
        codes *= powers(len(codes))
        np.cumsum(codes, out=codes)
        hashes[lo:hi] = codes[end - 1]
        hashes[lo + 1 : hi] -= codes[begin[1:] - 1]
        hashes[lo:hi] *= _inverses[begin]
        lo = hi
    return Words(data, first, last, row, mix(hashes))
