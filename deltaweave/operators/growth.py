"""Cells that grow on shared pools and divide: every cell sees the pool as it was, and mass is conserved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaweave.functions.names import unused
from deltaweave.operators import divide


def uptake(mass: Column, food: Column, k: float, dt: float) -> Column:
    """What a cell takes: k food mass dt, but neither more than there is nor less than nothing."""
    return F.greatest(F.lit(0.0), F.least(k * food * mass * dt, food))


def grow(cells: DataFrame, pools: DataFrame, place: str, k: float = 0.35, share: float = 0.6, dt: float = 1.0, mass: str = "mass") -> tuple[DataFrame, DataFrame]:
    """Cells and pools (``place, glucose, acetate``) after ``dt``: of what a cell takes, ``share`` becomes mass and the rest acetate."""
    taken, food = unused("taken", cells, pools), unused("food", cells, pools)
    fed = cells.join(pools.select(place, F.col("glucose").alias(food)), place, "left").withColumn(taken, uptake(F.col(mass), F.coalesce(food, F.lit(0.0)), k, dt))
    sums = fed.groupBy(place).agg(F.sum(taken).alias(taken))
    gone = F.coalesce(taken, F.lit(0.0))
    after = pools.join(sums, place, "left").withColumns({"glucose": F.col("glucose") - gone, "acetate": F.col("acetate") + gone * (1.0 - share)}).drop(taken)
    return fed.withColumn(mass, F.col(mass) + F.col(taken) * share).select(*cells.columns), after


def ready(cells: DataFrame, threshold: float = 2.0, mass: str = "mass", flag: str = "divide") -> DataFrame:
    """Each cell says whether it is heavy enough to divide."""
    return cells.withColumn(flag, F.coalesce(F.col(mass) > threshold, F.lit(False)))


def dispose(cells: DataFrame, place: str, key: str, extensive: list[str], flag: str = "divide") -> DataFrame:
    """In each place, of the cells that are ready the last by key divides; its daughters are not ready."""
    last = cells.where(F.col(flag)).groupBy(place).agg(F.max(key).alias(key)).withColumn("chosen", F.lit(True))
    name = unused("chosen", cells)
    marked = cells.join(last.withColumnRenamed("chosen", name), [place, key], "left")
    out = divide.divide_rows(marked, F.coalesce(F.col(name), F.lit(False)), key, extensive, override={flag: lambda _: F.lit(False)})
    return out.select(*cells.columns)
