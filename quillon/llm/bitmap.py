"""Bitmaps of bounded size over keys that Spark holds: which positions were set at all, or more than once.

Tasks set positions of their own rows, segments of the map are merged in Spark,
and only the map itself reaches the driver and the executors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.words import mix

#: Bits of a position within its segment; positions that a task holds before it puts them out.
SEGMENT, HELD = 16, 1_000_000


def bits_for(rows: int, bits_per_row: int, max_bits: int) -> int:
    """A power of two."""
    return 1 << max(SEGMENT, min((max(1, rows) * bits_per_row - 1).bit_length(), max_bits.bit_length() - 1))


def places(column: pa.Array, bits: int) -> np.ndarray:
    """Two positions for each 64-bit hash; null counts as 0."""
    return places_of(np.asarray(column.fill_null(0)).view(np.uint64), bits)


def places_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = mix(hashes)
    return np.stack([h, h >> np.uint64(32)], axis=1) & np.uint64(bits - 1)


def _count_udf(positions: Callable[[pa.Array, int], np.ndarray], bits: int):
    """Keys -> (segment, positions set at least once, positions set more often) of this partition."""

    def flush(held):
        pos, count = np.unique(np.concatenate(held), return_counts=True)
        seg = (pos >> np.uint64(SEGMENT)).astype(np.int64)
        low = (pos & np.uint64((1 << SEGMENT) - 1)).astype("<u2")
        cut = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        ends = np.r_[cut[1:], len(seg)]
        return pa.RecordBatch.from_arrays(
            [pa.array(seg[cut]), pa.array([low[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([low[a:b][count[a:b] > 1].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
            ["segment", "once", "more"],
        )

    def run(batches):
        held, n = [], 0
        for batch in batches:
            p = positions(batch.column(0), bits)
            held.append(np.r_[p[:, 0], p[:, 1][p[:, 1] != p[:, 0]]])
            n += len(p)
            if n > HELD:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _merge_udf(times: int):
    """Rows sorted by segment -> (segment, bitmap of what was set so many times)."""

    def run(batches):
        segment, count = None, np.zeros(1 << SEGMENT, np.uint8)

        def close():
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([np.packbits(count >= times).tobytes()], pa.binary())], ["segment", "bitmap"])

        for batch in batches:
            for seg, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seg != segment:
                    if segment is not None:
                        yield close()
                    segment = seg
                    count[:] = 0
                at = np.frombuffer(once, "<u2")
                count[at] = np.minimum(count[at] + 1, 2)
                count[np.frombuffer(more, "<u2")] = 2
        if segment is not None:
            yield close()

    return run


def bitmap(keys: DataFrame, positions: Callable[[pa.Array, int], np.ndarray], bits: int, times: int = 1) -> np.ndarray:
    """The packed bits that at least ``times`` (1 or 2) of ``keys`` (one column) have set; a key sets two positions."""
    parts = keys.mapInArrow(_count_udf(positions, bits), "segment long, once binary, more binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge_udf(times), "segment long, bitmap binary")
    out = np.zeros(bits // 8, np.uint8)
    width = (1 << SEGMENT) // 8
    for r in merged.toLocalIterator():  # bits / 8 bytes at most in all
        out[r.segment * width : (r.segment + 1) * width] = np.frombuffer(r.bitmap, np.uint8)
    return out


def all_set(bits: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """By row whether both positions are set."""
    return ((bits[positions >> np.uint64(3)] >> (7 - (positions & np.uint64(7)).astype(np.uint8))) & 1).all(axis=1)
