"""Bloom filters of bounded size over 64-bit keys, built by a few tasks; false hits only cost their users time.

Each task builds slices of its own, so the driver gets every bit once, not a whole filter from each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from deltaweave.llm.wordhash import mix

#: Least and most bits of a filter, bits for each key, the tasks that build one, and its slices.
LEAST, MOST, EACH, TASKS, SLICES = 1 << 16, 1 << 26, 16, 8, 64


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each key, one after the other for all keys."""
    h = mix(keys.view(np.uint64))
    return np.concatenate([h % np.uint64(bits), (h >> np.uint64(32)) % np.uint64(bits)]).astype(np.int64)


def holds(flags: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter, whose bits are packed in ``flags``."""
    at = places(keys, bits)
    return ((flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).reshape(2, -1).all(axis=0)


def _dealt(bits: int, keys_of: Callable[[pa.RecordBatch], np.ndarray]):
    """Places by slice, counted from the slice's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = bits // SLICES
        for batch in batches:
            at = np.sort(places(keys_of(batch), bits))
            edges = np.searchsorted(at, np.arange(SLICES + 1) * wide)
            full = np.flatnonzero(np.diff(edges))
            parts = [(at[edges[i] : edges[i + 1]] - i * wide).astype("<u4").tobytes() for i in full.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(parts, pa.binary())], ["slice", "places"])

    return run


def _marked(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                flags.setdefault(i, np.zeros(bits // SLICES, bool))[np.frombuffer(at, "<u4")] = True
        for i, own in flags.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["slice", "flags"])

    return run


def build(rows: DataFrame, count: int, keys_of: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[bytes, int]:
    """Packed flags and the number of bits for about ``count`` keys; ``keys_of`` gives the keys of a batch as 64-bit numbers."""
    bits = min(MOST, max(LEAST, 1 << (EACH * count).bit_length()))
    flags = np.zeros((SLICES, bits // SLICES // 8), np.uint8)
    dealt = rows.mapInArrow(_dealt(bits, keys_of), "slice int, places binary").repartition(TASKS, "slice").coalesce(TASKS)
    for row in dealt.mapInArrow(_marked(bits), "slice int, flags binary").toLocalIterator():
        flags[row["slice"]] = np.frombuffer(row["flags"], np.uint8)
    return flags.tobytes(), bits
