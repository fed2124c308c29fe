"""Bloom filters of bounded size, to leave out rows before a shuffle.

A filter has as many bits as the expected keys ask for, MOST_BITS at most, so it may be broadcast.  A row that it
leaves out is in none of the keys; what it lets through is joined as usual, so results do not depend on it: a
full filter only saves nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import pandas_udf

#: Bits of a filter at least and at most, and for each expected key.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
KEY_BITS = 12
#: A filter is filled in segments, each by a task: so many at least, and keys of one about.
SEGMENTS, SEGMENT_KEYS = 64, 1 << 20

_PRIME = np.uint64(0x9E3779B185EBCA87)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def packed(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(key, columns as bytes) of the rows of each key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    for a, b in zip(starts, np.r_[starts[1:], len(keys)] if len(keys) else []):
        yield int(keys[a]), *[c[order[a:b]].tobytes() for c in columns]


def _places(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, 32 further bits) of each key (long)."""
    raw = keys.view(np.uint64)
    mixed = (raw ^ (raw >> np.uint64(29))) * _PRIME
    segment = (mixed >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
    return segment.astype(np.int64), (((mixed ^ (mixed >> np.uint64(31))) * _MIX) >> np.uint64(32)).astype(np.uint32)


def _bits(low: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a segment of ``size`` bytes that 32 bits of a key stand for."""
    bits = np.uint64(8 * size)
    wide = low.astype(np.uint64)
    return ((wide * _PRIME >> np.uint64(20)) % bits).astype(np.int64), (((wide ^ np.uint64(0x5BD1E995)) * _MIX >> np.uint64(20)) % bits).astype(np.int64)


def column_keys(batch: pa.RecordBatch) -> np.ndarray:
    """The keys that the first column holds, nulls left out."""
    return batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)


def filter_of(rows: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]] | str, expected: int, least: int = 1, segments: int | None = None) -> Broadcast:
    """Broadcast (bytes, segments) of the keys that ``rows`` hold ``least`` (1 or 2) times or more.

    ``keys``: a column of longs, or what makes arrays of keys of the batches.  A batch sends a key ``least``
    times at most, so a key that most rows hold is no burden to its segment.  ``expected`` keys decide its size and
    its ``segments``; more of them only let more through.  32 bits of a key are sent, which with segments in proportion
    to the keys tell nearly all of them apart.
    """
    segments = segments or min(MOST_BITS // 64, max(SEGMENTS, -(-expected // SEGMENT_KEYS)))
    size = max(1, min(MOST_BITS, max(LEAST_BITS, KEY_BITS * expected)) // segments // 8)
    made = keys if callable(keys) else lambda batches: map(column_keys, batches)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in made(batches):
            values, counts = np.unique(held, return_counts=True)
            segment, low = _places(np.repeat(values, np.minimum(counts, least)), segments)
            parts = list(packed(segment, low))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in parts], pa.int64()), pa.array([r[1] for r in parts], pa.binary())], names=["segment", "keys"])

    def filled(table: pa.Table) -> pa.Table:
        values, counts = np.unique(np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32), return_counts=True)
        bits = np.zeros(8 * size, np.uint8)
        for places in _bits(values[counts >= least], size):
            bits[places] = 1
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    source = rows if callable(keys) else rows.select(keys)
    found = source.mapInArrow(dealt, "segment long, keys binary").groupBy("segment").applyInArrow(filled, "segment long, bits binary")
    bloom = np.zeros(size * segments, np.uint8)
    for row in found.collect():  # MOST_BITS in all
        bloom[row.segment * size : (row.segment + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast((bloom, segments))


def held(keys: np.ndarray, bloom: tuple[np.ndarray, int]) -> np.ndarray:
    """Which of ``keys`` may be in the filter."""
    bits, segments = bloom
    segment, low = _places(keys, segments)
    size = len(bits) // segments
    start = segment * (8 * size)
    found = np.ones(len(keys), bool)
    for bit in _bits(low, size):
        place = start + bit
        found &= (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
    return found


def maybe(key: Column, bloom: Broadcast) -> Column:
    """Whether a key (a long, not null) may be in the filter."""

    @pandas_udf("boolean")
    def looked_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(held(keys.to_numpy(np.int64), bloom.value))

    return looked_up(key)
