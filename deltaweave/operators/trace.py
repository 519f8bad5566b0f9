"""Event-sourced traces: frames to deltas, deltas to frames, and comparison of time series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaweave.functions import sorts


def trace_of(frames: DataFrame, trace: list[str], order: list[str], value: str) -> DataFrame:
    """Initial value, then differences; an unchanged frame has a null delta.

    A value that follows a null is told whole, like an initial one; a null after a value is no change.
    """
    w = Window.partitionBy(*trace).orderBy(*order)
    i = F.row_number().over(w) - 1
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    change = F.when(before.isNull(), F.col(value)).when(F.col(value) != before, F.col(value) - before)
    return frames.withColumns({"i": i.cast("long"), "delta": change})


def frames(trace: DataFrame, keys: list[str], order: list[str], delta: str, out: str) -> DataFrame:
    """Running fold of additive deltas."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return trace.withColumn(out, F.sum(F.coalesce(delta, F.lit(0.0))).over(w))


def state_at(trace: DataFrame, keys: list[str], index: str, at: int, delta: str, out: str) -> DataFrame:
    """The fold of the first deltas up to ``at``; beyond the end it is the last state."""
    return trace.where(F.col(index) <= at).groupBy(*keys).agg(F.sum(delta).alias(out))


def species_mse(a: DataFrame, b: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Mean squared difference per key over the common prefix."""
    left, right = a.select(*keys, index, F.col(value).alias("_a")), b.select(*keys, index, F.col(value).alias("_b"))
    return left.join(right, [*keys, index]).groupBy(*keys).agg(F.avg((F.col("_a") - F.col("_b")) * (F.col("_a") - F.col("_b"))).alias("mse"), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Trace:
    """Rows ``i, time`` and a state per frame, with the trace's name and the sort of its elements."""

    rows: DataFrame
    name: str = "trace"
    element: sorts.Sort = sorts.ANY

    def times(self) -> DataFrame:
        return self.rows.select("i", "time").distinct().orderBy("i")

    def __len__(self) -> int:
        return self.rows.select("i").distinct().count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def series(self, path: str) -> DataFrame:
        """``time, value`` of one path over all frames (a nested path with dots)."""
        return self.rows.select("i", "time", F.col(path).alias("value"))
