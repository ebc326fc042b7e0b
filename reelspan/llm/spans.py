"""Words and span hashes of many texts at once, on the bytes of an Arrow column.

Hashes are prefix sums of ``value * BASE**position`` modulo 2**64, so the hash
of any span is one subtraction and one multiplication by a power of the
inverse; a finaliser then spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from reelspan.llm.bloom import mix

#: Bytes of text handled at once, unless one text is longer.
CHUNK_BYTES = (1 << 19) - 1
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: The bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PLAIN = np.arange(1, 257, dtype=np.uint64)
LOWER = PLAIN.copy()
LOWER[65:91] += np.uint64(32)

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); equal spans have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start])


def text_chunks(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of texts of about CHUNK_BYTES; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        own = offsets[first : last + 1]
        yield slice(first, last), data[own[0] : own[-1]], own - own[0]
        first = last


class Words:
    """The words of a chunk: byte ranges, the hash of each, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, values: np.ndarray = PLAIN, space: np.ndarray = SPACE):
        inside = ~space[data]
        full = offsets[:-1] < offsets[1:]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][full]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[offsets[1:][full] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)  # of text i: words first[i] to first[i + 1]
        self.prefix = prefix_sums(values[data])
        self.hash = span_hashes(self.prefix, self.start, self.end)
