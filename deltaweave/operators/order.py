"""Places and running sums over a whole table without a task that holds all of it.

Rows are range partitioned and sorted by the given order; each partition's total is one small row, and
what lies before a partition is the sum of the totals of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaweave.functions.names import unused
from deltaweave.runtime import stage


def running(rows: DataFrame, order: list[str], amount: str | None, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``amount`` up to and with each row (null amounts count as 0), or, without ``amount``, the row's place from 0."""
    part = unused("part", rows, [out])
    base = unused("base", rows, [out, part])
    dealt = rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    dealt = stage(dealt, "ordered")  # the range bounds are sampled, so they have to be fixed before they are used twice
    size = F.count(F.lit(1)) if amount is None else F.coalesce(F.sum(amount), F.lit(0))
    totals = dealt.groupBy(part).agg(size.alias(base))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    before = totals.select(part, F.coalesce(F.sum(base).over(earlier), F.lit(0)).alias(base))
    inside = Window.partitionBy(part).orderBy(*order)
    here = F.row_number().over(inside) - 1 if amount is None else F.coalesce(F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    return dealt.join(F.broadcast(before), part).withColumn(out, F.col(base) + here).drop(part, base)
