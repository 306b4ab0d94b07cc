"""A pair of Bloom filters over 64-bit hashes: seen once, and seen at least twice.

The hash space is cut into segments.  Each segment is filled by one task that reads packed hashes
as a stream and keeps two bit arrays of fixed size, so memory never follows the number of hashes.
Only the twice-seen filter leaves the tasks.  Its size is bounded by ``max_bits``: beyond
that it lets more false suspects through, which the callers' exact confirmation sorts out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, tidy

#: Segments of the hash space, a power of two; also the most tasks that fill filters.
SEGMENTS = 64
#: Hashes that a task should fill filters with at least.
LEAST_HASHES = 1 << 18
#: Bound of the broadcast filter: 2**28 bits are 32 MB.
MAX_BITS = 1 << 28
BITS_PER_HASH = 12
PROBES = 4

PACKED = "seg int, n long, once binary, twice binary"


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions inside a segment of ``bits`` (a power of two), one row for each probe."""
    h = hashes * np.uint64(0x9E3779B97F4A7C15)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((a + steps * b) & np.uint64(bits - 1)).astype(np.int64)


def get_bits(field: np.ndarray, where: np.ndarray) -> np.ndarray:
    return ((field[where >> 3] >> (where & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def set_bits(field: np.ndarray, where: np.ndarray) -> None:
    flat = where.ravel()
    np.bitwise_or.at(field, flat >> 3, np.left_shift(1, flat & 7).astype(np.uint8))


def segment_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(58)).astype(np.int64)


def packed_rows(hashes: np.ndarray) -> pa.RecordBatch:
    """Rows of PACKED from a batch's hashes, in which each document holds a hash once at most."""
    unique, counts = np.unique(hashes, return_counts=True)
    edges = np.searchsorted(segment_of(unique), np.arange(SEGMENTS + 1))
    segs, sizes, once, twice = [], [], [], []
    for s in range(SEGMENTS):
        part = unique[edges[s] : edges[s + 1]]
        if len(part):
            again = part[counts[edges[s] : edges[s + 1]] > 1]
            segs.append(s)
            sizes.append(len(part))
            once.append(part.tobytes())
            twice.append(again.tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(segs, pa.int32()), pa.array(sizes, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
        names=["seg", "n", "once", "twice"],
    )


class TwiceFilter:
    """Answers whether a hash may have been seen twice; never wrongly no."""

    def __init__(self, bits: int, segments: dict[int, bytes]) -> None:
        self.bits, self.segments, self._fields = bits, segments, None

    def __getstate__(self) -> tuple:
        return self.bits, self.segments

    def __setstate__(self, state: tuple) -> None:
        (self.bits, self.segments), self._fields = state, None

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        if self._fields is None:
            self._fields = np.zeros((SEGMENTS, self.bits // 8), np.uint8)
            for s, packed in self.segments.items():
                self._fields[s] = np.frombuffer(zlib.decompress(packed), np.uint8)
        where = positions(hashes, self.bits) + segment_of(hashes) * self.bits
        return get_bits(self._fields.reshape(-1), where)


def hash_ids(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B185EBCA87)


def member_filter(df: DataFrame, column: str, name: str, max_bits: int = MAX_BITS) -> TwiceFilter:
    """A filter of the whole numbers in a column: the once-seen filter of the pair."""
    packed = df.select(column).distinct().mapInArrow(tidy(lambda batches: (packed_rows(hash_ids(b.column(0).to_numpy())) for b in batches)), PACKED)
    return twice_filter(packed, name, max_bits, once=True)


def twice_filter(packed: DataFrame, name: str, max_bits: int = MAX_BITS, once: bool = False) -> TwiceFilter:
    """Fill both filters from rows of PACKED and return the twice-seen one, or the once-seen."""
    packed = materialise(packed, f"{name}-hashes")
    total = packed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits = 1 << max(10, int(np.ceil(np.log2(max(1, min(max_bits, total * BITS_PER_HASH) / SEGMENTS)))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, first, again in zip(*(batch.column(c).to_pylist() for c in ("seg", "once", "twice")), strict=True):
                one, two = fields.setdefault(s, (np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)))
                hashes = np.frombuffer(first, np.uint64)
                where = positions(hashes, bits)
                set_bits(two, where[:, get_bits(one, where)])
                set_bits(two, positions(np.frombuffer(again, np.uint64), bits))
                set_bits(one, where)
        if fields:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(fields), pa.int32()), pa.array([zlib.compress(f[0 if once else 1].tobytes(), 1) for f in fields.values()], pa.binary())],
                names=["seg", "bits"],
            )

    rows = packed.repartition(max(1, min(SEGMENTS, total // LEAST_HASHES)), "seg").select("seg", "once", "twice").mapInArrow(tidy(fill), "seg int, bits binary").collect()
    release(packed)
    return TwiceFilter(bits, {r["seg"]: bytes(r["bits"]) for r in rows})
