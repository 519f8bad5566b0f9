"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with at least this part of all rows (so at most as many keys are) and at least so many rows.
HOT_PART, HOT_LEAST = 256, 64
#: Over how many tasks the rows of a hot key are dealt.
SALTS = 64


def hot_keys(counted: DataFrame, key: str, n: str = "n", total: int | None = None) -> list[int]:
    """The keys of ``counted(key, n)`` that hold a large share of all rows: at most ``HOT_PART``; none among few rows."""
    if total is None:
        total = counted.agg(F.sum(n)).first()[0] or 0
    if total < HOT_PART * HOT_LEAST:
        return []
    return [r[0] for r in counted.where((F.col(n) >= HOT_LEAST) & (F.col(n) * HOT_PART >= total) & F.col(key).isNotNull()).select(key).collect()]


def join_hot(rows: DataFrame, lookup: DataFrame, keys: list[str], hot: list[int], by: str | Column, how: str = "inner") -> DataFrame:
    """``rows.join(lookup, keys, how)`` where ``lookup`` has one row for each key, and rows whose first key is ``hot`` are dealt by ``by``.

    The lookup rows of hot keys are copied ``SALTS`` times, which their bounded number allows.
    ``how`` is "inner" or "left".
    """
    if not hot:
        return rows.join(lookup, keys, how)
    found = F.col(keys[0]).isin(hot)
    dealt = rows.withColumn("salt", F.when(found, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    copied = lookup.withColumn("salt", F.explode(F.when(found, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied, [*keys, "salt"], how).drop("salt")
