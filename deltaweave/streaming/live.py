"""Live stores: streams of deltas folded into running totals and windows.

The fold is Spark's own streaming aggregation: deltas combine before the shuffle, the state store holds
one row per key, and progress survives restarts through the checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from deltaweave.runtime import shared_dir


def totals(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running sum and count per key; null values count as no update."""
    return stream.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(value).alias("state"), F.count(F.lit(1)).alias("n"))


def windows(stream: DataFrame, keys: list[str], time: str, value: str, width: str, late: str) -> DataFrame:
    """Sum per key and window of time; rows later than ``late`` are dropped, as their windows are closed."""
    watched = stream.withWatermark(time, late)
    return watched.groupBy(F.window(time, width).alias("window"), *keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def changes(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A live filter that puts out differences: for each batch and key, the change of the running sum since the batch before, and the sum.

    The sum is held in the state store; a batch whose values cancel out puts out nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (before,) = state.get if state.exists else (0.0,)
        now = before + sum(float(frame[value].dropna().sum()) for frame in frames)
        state.update((now,))
        if now != before:
            yield pd.DataFrame([(*key, now - before, now)], columns=[*keys, "delta", "state"])

    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    grouped = stream.select(*keys, F.col(value).cast("double").alias(value)).groupBy(*keys)
    return grouped.applyInPandasWithState(step, f"{kinds}, delta double, state double", "total double", "append", GroupStateTimeout.NoTimeout)


def collected(told: DataFrame) -> DataFrame:
    """Run a stream in append mode over all that is there, and return all it put out, each batch once."""
    spark = told.sparkSession
    base = f"{shared_dir(spark)}/deltaweave/{uuid.uuid4().hex}"
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
    told.writeStream.outputMode("append").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(T.StructType([*told.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/rows")


def drain(live_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream in update mode over all that is there, and return the last row of each key.

    Each batch writes its changed rows under its own number, overwriting on a second try, so a batch
    that is run again after a failure counts once.
    """
    spark = live_rows.sparkSession
    base = f"{shared_dir(spark)}/deltaweave/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    running = live_rows.writeStream.outputMode("update").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()
    rows = [c for c in live_rows.columns if c not in keys]
    told = spark.read.schema(T.StructType([*live_rows.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/rows")
    return told.groupBy(*keys).agg(F.max_by(F.struct(*rows), "batch").alias("_last")).select(*keys, "_last.*")
