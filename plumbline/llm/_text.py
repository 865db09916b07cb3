"""Vectorised words, hashes and windows over Arrow string columns.

Texts are handled as one UTF-8 buffer per slice of a column. Hashes are polynomials modulo 2**64 over a
random value per byte, finished by a bijective mixer, so that each costs a few array passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F
BLOCK = 1 << 18
BYTE_VALUES = np.random.default_rng(0x5EED).integers(1, 2**64, 256, dtype=U64)

#: The six ASCII white-space bytes separate words.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters (lower case), digits and everything beyond ASCII are parts of words.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept, and doubled when more are needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * BLOCK if have is None else 2 * len(have))
        have = np.full(size, base, U64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U64)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the len+1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 4 << 20):
    """(first, last) row ranges of at most so many bytes each; a longer text has a range of its own."""
    _, offsets = buffer(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of a string column: byte ranges in one buffer, and where each text's words begin."""

    def __init__(self, column: pa.Array | tuple[np.ndarray, np.ndarray], part: np.ndarray = SPACED, lower: bool = False):
        data, self.offsets = column if isinstance(column, tuple) else buffer(column)
        self.data = LOWER[data] if lower else data
        inside = part[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: Text d has the words first[d] to first[d + 1].
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), U64)
        a, n = 0, len(out)
        while a < n:
            base = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, base + BLOCK, "right")))
            seg = BYTE_VALUES[self.data[base : self.ends[b - 1]]]
            seg *= powers(BASE, len(seg))
            total = np.zeros(len(seg) + 1, U64)
            np.cumsum(seg, out=total[1:])
            s = self.starts[a:b] - base
            out[a:b] = (total[self.ends[a:b] - base] - total[s]) * powers(inverse(BASE), len(seg))[s]
            a = b
        return mix(out + (self.ends - self.starts).astype(U64))


def rolling(words: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """Rabin-Karp hash of the n words from each position at which so many are left."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * powers(base, len(words)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(inverse(base), count) + U64(n))


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Positions at which a window of n words begins that lies within one text."""
    lengths = np.maximum(np.diff(first) - n + 1, 0)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(first[:-1] - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total) + skip


def covered(count: int, starts: np.ndarray, lengths: int | np.ndarray) -> np.ndarray:
    """Which of count positions lie in any of the ranges."""
    steps = np.bincount(starts, minlength=count + 1)[: count + 1] - np.bincount(starts + lengths, minlength=count + 1)[: count + 1]
    return np.cumsum(steps)[:count] > 0


def runs(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true flags that don't cross from one text into the next: first and last + 1 positions."""
    begin, end = flags.copy(), flags.copy()
    begin[1:] &= ~flags[:-1]
    end[:-1] &= ~flags[1:]
    edges = first[(first > 0) & (first < len(flags))]
    begin[edges] = flags[edges]
    end[edges - 1] = flags[edges - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1
