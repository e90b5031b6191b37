"""Bloom filters in segments: filled by each partition on its own, merged by OR, and folded to a bound."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Bits of one segment's filter.
SEGMENT_BITS = 1 << 21
#: Rows of partial filters: the segment and the places of bits seen once and seen twice.
PARTS = "s int, o binary, t binary"
PROBES = 2
_COMPRESS, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _places(hashes: np.ndarray) -> np.ndarray:
    """The places of each hash in its segment's filter."""
    return np.stack([(hashes >> np.uint64(21 * i)) & np.uint64(SEGMENT_BITS - 1) for i in range(PROBES)], axis=1).astype(np.int64)


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes >> np.uint64(48)).astype(np.int64) * segments) >> 16


def _packed(places: np.ndarray) -> bytes:
    """Distinct places in order, as compressed differences."""
    return _COMPRESS.compress(np.diff(np.unique(places), prepend=0).astype(np.uint32).tobytes())


def _places_of(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_EXPAND.decompress(packed), np.uint32), dtype=np.int64)


def merged(parts: Iterable[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Two filters of one segment from those of the partitions: (once, twice)."""
    once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for o, t in parts:
        o = _places_of(o)
        twice[_places_of(t)] = True
        twice[o[once[o]]] = True
        once[o] = True
    return once, twice


@dataclass(frozen=True)
class Filter:
    """One filter of each segment, folded to `bits` bits."""

    segments: int
    bits: int
    held: np.ndarray  # bytes, segment by segment

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be in the filter."""
        at = _segment(hashes, self.segments)[:, None] * self.bits + _places(hashes) % self.bits
        return ((self.held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def segments_for(bits: int) -> int:
    return max(1, min(1 << 16, -(-bits // SEGMENT_BITS)))


def parts(hashes: np.ndarray, again: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
    """The partial filters of distinct sorted hashes, some of which a partition has seen again."""
    if len(hashes):
        cuts = np.searchsorted(_segment(hashes, segments), np.arange(segments + 1))
        filled = [s for s in range(segments) if cuts[s] < cuts[s + 1]]
        at = [slice(cuts[s], cuts[s + 1]) for s in filled]
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([_packed(_places(hashes[p])) for p in at], pa.binary()), pa.array([_packed(_places(hashes[p][again[p]])) for p in at], pa.binary())], names=["s", "o", "t"])


def collected(found: DataFrame, segments: int, most_bytes: int, *, twice: bool) -> Filter:
    """The first or second filter from partial ones, at most most_bytes (a few bytes a segment at the least)."""
    fold = 1
    while segments * SEGMENT_BITS // 8 // fold > most_bytes and SEGMENT_BITS // fold > 64:
        fold *= 2

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for s, some in itertools.groupby(rows(), key=lambda r: r[0]):
            bits = merged(r[1:] for r in some)[twice]
            if bits.any():
                held = np.packbits(bits.reshape(fold, -1).any(axis=0), bitorder="little")
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["s", "f"])

    bits = SEGMENT_BITS // fold
    out = np.zeros(segments * bits // 8, np.uint8)
    for s, f in found.repartition(segments, "s").sortWithinPartitions("s").mapInArrow(merge, "s int, f binary").collect():  # most_bytes in all
        out[s * bits // 8 : (s + 1) * bits // 8] = np.frombuffer(f, np.uint8)
    return Filter(segments, bits, out)
