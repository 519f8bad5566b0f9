"""Groups of sorted Arrow batches, for ``mapInArrow`` over partitions that are sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: int, most: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' edges; a group is a run of rows with equal first ``keys`` columns.

    Many small groups come in one table of about ``most`` rows; a group is never cut.
    """
    held: list[pa.RecordBatch] = []

    def change(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(table.num_rows - 1, 0), bool)
        for i in range(keys):
            new |= np.diff(np.asarray(table.column(i).combine_chunks())) != 0
        return np.flatnonzero(new) + 1

    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        edges = change(table)
        if len(edges):
            yield table.slice(0, edges[-1]), np.concatenate([[0], edges])
            held = table.slice(edges[-1]).to_batches()
            rows = table.num_rows - edges[-1]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.concatenate([[0], change(table), [table.num_rows]])
