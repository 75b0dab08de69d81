"""Vectorised text primitives over Arrow string buffers.

Word = a maximal run of bytes that are ASCII letters or digits or lie outside ASCII (so any
non-ASCII character is a word character). Case folding covers ASCII and Latin-1 letters. All
functions work on slices of about a megabyte, whatever the size of a batch, so memory stays flat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        _powers[0], _powers[1] = _geometric(_R, size), _geometric(_RINV, size)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1, valid) of a string column, without copying the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64), np.zeros(len(column), bool)
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if where is not None and n else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    return raw, offsets, valid


def slices(raw: np.ndarray, offsets: np.ndarray, most: int = 1 << 20, rows: int = 8192) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, own offsets): whole documents, about ``most`` bytes together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(lo + 1, hi), lo + rows)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin-1 letters; lengths don't change."""
    out = _FOLD[data]
    if len(data) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        b = data[at]
        at = at[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
        out[at] += 32
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = WORD[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = False
    before[1:], after[:-1] = w[:-1], w[1:]
    cut = offsets[:-1]
    before[cut[cut < n]] = False
    cut = offsets[1:]
    after[cut[cut > 0] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class Hasher:
    """Hashes of any spans of one slice, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        p, self.inverse = _power(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * p[:n], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def hash_text(word: str) -> int:
    """The hash that Hasher gives the same (already folded) word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Hasher(data).spans(np.array([0]), np.array([len(data)]))[0])
