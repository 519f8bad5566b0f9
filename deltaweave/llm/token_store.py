"""Token ids of whole documents in a Simple-8b file format, written and read by Spark.

The store is a Parquet table with one row per segment; a segment holds whole documents, about
``SEGMENT_IDS`` ids, as Simple-8b words with per-block word offsets and an escape list (see
``simple8b``).  Rows carry the shard (range partition), their number and the count of the shard's ids before them, so the concatenation by
(shard, segment) is the corpus in ascending document order.  Spark's commit protocol makes a lost
executor harmless, and any store that Spark can write to will do.

Only texts are range partitioned; ids are encoded where they are made and never shuffled.  The
global start of a segment is the sum of shard totals before it: one small row per shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaweave.llm import simple8b
from deltaweave.llm.tokens import encoder, slices
from deltaweave.runtime import ship, stage, table

SEGMENT_IDS = 1 << 18
SEGMENT_SCHEMA = "shard int, segment int, before bigint, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, block int, offsets binary, words binary, escapes binary"
_ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("block", pa.int32()), ("offsets", pa.binary()), ("words", pa.binary()), ("escapes", pa.binary())])


def _segment(shard: int, number: int, before: int, keys: list, ids: list[bytes], block: int) -> pa.RecordBatch:
    values = np.frombuffer(b"".join(ids), "<u4")
    words, offsets, escapes = simple8b.encode(values, block)
    row = [shard, number, before, keys, [len(x) // 4 for x in ids], len(values), block, offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _ARROW.types)], schema=_ARROW)


def _write(path: str, end_id: int, segment_ids: int, block: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, before, keys, ids, held = TaskContext.get().partitionId(), 0, 0, [], [], 0
        for batch in slices(batches):
            for key, packed in zip(batch.column(0).to_pylist(), encoder(path).packed(batch.column(1))):
                keys.append(key)
                ids.append(bytes(packed) + end)
                held += len(ids[-1]) // 4
                if held >= segment_ids:
                    yield _segment(shard, number, before, keys, ids, block)
                    number, before, keys, ids, held = number + 1, before + held, [], [], 0
        if keys:
            yield _segment(shard, number, before, keys, ids, block)

    return run


def write_store(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS, block: int = simple8b.BLOCK) -> DataFrame:
    """Encode every document and write the store; returns the stored segments.

    Documents are in ascending key order, null keys first; rows with equal keys follow each other in
    any order.  Null texts count as empty and hold only ``end_id``.  A document longer than a
    segment has a segment of its own.  Extra columns are ignored.
    """
    ship(docs.sparkSession)
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key")
    return stage(ordered.mapInArrow(_write(path, end_id, segment_ids, block), SEGMENT_SCHEMA), "token_store")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
            raw = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)  # noqa: B023, E731
            n = row["n_ids"].as_py()
            ids = simple8b.decode(raw("words", "<u8"), raw("offsets", "<i8"), raw("escapes", "<u8"), n, row["block"].as_py()).astype("<u4")
            lengths = np.asarray(row["lengths"].values, np.int64)
            starts = np.cumsum(lengths) - lengths
            view = memoryview(ids.tobytes())
            crcs = [zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(starts.tolist(), lengths.tolist())]
            columns = [row["doc_ids"].values, pa.array(starts + row["base"].as_py(), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_store(store: DataFrame) -> DataFrame:
    """Decode a store: ``doc_id, start, n_tokens, ids_crc32`` per document."""
    sizes = store.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_base"))
    based = store.join(F.broadcast(shards), "shard").withColumn("base", F.col("shard_base") + F.col("before"))
    return based.drop("shard", "segment", "before", "shard_base").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the store and back."""
    return read_store(write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1))
