"""Bloom filters over 64-bit hashes, built by the executors and broadcast within a fixed size.

A filter has 16 bits for each expected key up to ``MAX_BITS`` (2**29 bits, 64
MiB), so its broadcast is bounded whatever the input.  Past that bound more
keys pass by chance; every caller checks the keys that pass exactly, so a full
filter costs time and never changes a result.

Build: each task turns its keys into two bit positions inside one segment of
at most 2**22 bits and sends, per segment, the positions it saw once and the
ones it saw again.  A second step merges the pieces of a segment, one after the
other, into one bitmap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 29
SEGMENT_BITS = 1 << 22
BITS_PER_KEY = 16


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def probes(keys: np.ndarray, segments: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment and the two positions in it of each int64 key."""
    x = mix(keys.view(np.uint64))
    low = np.uint64(segment_bits - 1)
    return (
        ((x >> np.uint64(44)) & np.uint64(segments - 1)).astype(np.int64),
        (x & low).astype(np.int64),
        ((x >> np.uint64(22)) & low).astype(np.int64),
    )


def bits_for(expected: int, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, max(1 << 16, 1 << (BITS_PER_KEY * max(expected, 1) - 1).bit_length()))


class Filter:
    """A broadcast bitmap and the shape that probes need."""

    def __init__(self, shared, segments: int, segment_bits: int):
        self.shared, self.segments, self.segment_bits = shared, segments, segment_bits

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Which int64 keys may be in the filter; for use inside tasks."""
        segment, a, b = probes(keys, self.segments, self.segment_bits)
        bitmap, base = self.shared.value, segment * self.segment_bits
        a, b = a + base, b + base
        return ((bitmap[a >> 3] >> (a & 7)) & (bitmap[b >> 3] >> (b & 7)) & 1).astype(bool)

    def maybe(self, key: str | Column) -> Column:
        """A boolean column: may this bigint key be in the filter?"""
        own = self

        @F.pandas_udf("boolean")
        def test(keys: pd.Series) -> pd.Series:
            return pd.Series(own.hits(keys.to_numpy(np.int64)))

        return test(key)


def build(keys: DataFrame, expected: int, repeated: bool = False, max_bits: int = MAX_BITS) -> Filter:
    """A filter of the one bigint column of ``keys`` (no nulls).

    ``repeated``: only of positions that were set more than once, so that a key
    passes if it may occur in several rows.
    """
    spark = keys.sparkSession
    bits = bits_for(expected, max_bits)
    segment_bits = min(bits, SEGMENT_BITS)
    segments = bits // segment_bits
    name = keys.columns[0]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.empty(0, np.int64)]
        for batch in batches:
            segment, a, b = probes(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False), segments, segment_bits)
            found += [segment * segment_bits + a, (segment * segment_bits + b)[a != b]]
        position, n = np.unique(np.concatenate(found), return_counts=True)
        cuts = np.searchsorted(position, np.arange(segments + 1) * segment_bits)
        for k in np.flatnonzero(np.diff(cuts)):
            own = (position[cuts[k] : cuts[k + 1]] - k * segment_bits).astype("<u4")
            again = own[n[cuts[k] : cuts[k + 1]] > 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([again.tobytes()], pa.binary())],
                names=["segment", "once", "again"],
            )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, twice = None, np.zeros(segment_bits, bool), np.zeros(segment_bits, bool)

        def packed() -> pa.RecordBatch:
            bits = np.packbits(twice if repeated else seen, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            for segment, once, again in zip(*batch.columns, strict=True):
                if segment.as_py() != now:
                    if now is not None:
                        yield packed()
                    now = segment.as_py()
                    seen[:], twice[:] = False, False
                own = np.frombuffer(once.as_buffer(), "<u4")
                twice[own[seen[own]]] = True
                twice[np.frombuffer(again.as_buffer(), "<u4")] = True
                seen[own] = True
        if now is not None:
            yield packed()

    rows = (
        keys.select(F.col(name).cast("bigint"))
        .mapInArrow(pieces, "segment int, once binary, again binary")
        .repartition("segment").sortWithinPartitions("segment")
        .mapInArrow(merged, "segment int, bits binary")
        .collect()  # at most MAX_BITS / 8 bytes
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in rows:
        at = row["segment"] * segment_bits // 8
        bitmap[at : at + segment_bits // 8] = np.frombuffer(row["bits"], np.uint8)
    return Filter(spark.sparkContext.broadcast(bitmap), segments, segment_bits)
