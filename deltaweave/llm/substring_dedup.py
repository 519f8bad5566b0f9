"""Exact substring dedup with fixed-block anchors.

A repeated window of ``WINDOW`` words holds, wherever it lies in the document that comes first, a
whole block of ``BLOCK`` words that starts at a multiple of ``BLOCK`` (2 * BLOCK - 1 <= WINDOW).

1. Index and probe.  Every document's non-overlapping blocks are indexed by hash, and every rolling
   window of ``BLOCK`` words of every document probes the index.  Both sides are dealt by hash: a
   task packs its probes into one row per bucket, with one entry per distinct hash, so a passage
   that a third of all rows share sends one entry per task.  A hash with a block and another
   occurrence is a hit.
2. Extend.  Around the hits, windows of ``WINDOW`` words are compared by 96-bit hashes, dealt
   the same way; the smallest (document, start) of each window is its first occurrence and every
   other one is a repeat.  Runs of repeated windows are the maximal exact repeats.
3. Remove.  Words that a repeated window covers are dropped from the text.

No pairs of documents are formed, nothing is capped, and no group of occurrences meets in one task
other than as one entry per task.  The number of buckets grows with the text, that of shuffle
partitions up to ``MOST_PARTITIONS``; a task takes its buckets one by one from a sorted shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.tokens import slices
from deltaweave.llm.wordhash import hashes, inside, rolling, words_of
from deltaweave.runtime import ship, shuffle_width, stage, table

BLOCK, WINDOW = 10, 20
#: Characters of text for each bucket; the most shuffle partitions, each of which takes many buckets one by one.
BUCKET_CHARS, MOST_PARTITIONS = 8_000_000, 1 << 14

_DEALT = "bucket int, batch long, kind int, a binary, b binary, c binary"
_ROWS = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_BACK = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_BACK_SQL = "batch long, kind int, a binary, b binary, c binary"
_FLAGS = pa.schema([("key", pa.int64()), ("tag", pa.int64()), ("places", pa.binary())])
ENTRY, TABLE = 0, 1


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Document keys (null: the smallest number) and text tags."""
    keys = batch.column(0).fill_null(np.iinfo(np.int64).min)
    return np.asarray(keys, np.int64), np.asarray(batch.column(1), np.int64)


def _batch_id(keys: np.ndarray, tags: np.ndarray, salt: int) -> int:
    """Depends on content alone, so a task that runs again makes the same rows."""
    return int.from_bytes(hashlib.blake2b(keys.tobytes() + tags.tobytes() + bytes([salt]), digest_size=8).digest(), "little", signed=True)


def _deal(batch: int, order: np.ndarray, bucket: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple]:
    """Entries as one packed row per bucket; ``order`` sorts by bucket."""
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges) if len(order) else []:
        yield (int(bucket[part[0]]), batch, ENTRY, *(x[part].tobytes() for x in arrays))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


def _probe(buckets: int, block: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, tags = _keys(batch)
            words, counts = words_of(batch.column(2))
            starts = np.cumsum(counts) - counts
            many = np.where(counts >= window, counts - block + 1, 0)  # texts too short for a window neither index nor probe
            at = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            if not len(at):
                continue
            key = rolling(hashes(words), block)[at]
            number = _batch_id(keys, tags, 1)
            of = np.searchsorted(starts, at, "right") - 1
            anchor = (at - starts[of]) % block == 0
            order = np.argsort(key, kind="stable")
            first = np.concatenate([[True], np.diff(key[order]) != 0])
            group = np.cumsum(first) - 1
            many = np.bincount(group)
            lead = order[first]
            anchored = np.bincount(group, anchor[order]) > 0
            local = np.zeros(len(words), np.uint8)
            local[at[order[many[group] > 1]]] = 1
            bucket = (key[lead] % np.uint64(buckets)).astype(np.int32)
            entries = (key[lead] >> np.uint64(32)).astype("<u4")
            spot = (at[lead].astype(np.uint32) << np.uint32(1)) | anchored.astype(np.uint32)
            sort = np.lexsort((spot, bucket))
            rows = [(b, n, k, x, y, None) for b, n, k, x, y in _deal(number, sort, bucket, [entries, spot.astype("<u4")])]
            rows.append((int(number % buckets), number, TABLE, np.stack([keys, tags, counts]).astype("<i8").tobytes(), np.packbits(local).tobytes(), None))
            yield _rows(rows, _ROWS)

    return run


def _column(table_: pa.Table, name: str) -> list:
    return table_.column(name).to_pylist()


def _meet(table_: pa.Table) -> pa.Table:
    """Hits among the entries of one bucket, as places to send back to their batches."""
    out, entries = [], []
    for batch, kind, a, b, c in zip(*(_column(table_, n) for n in ("batch", "kind", "a", "b", "c"))):
        if kind == TABLE:
            out.append((batch, TABLE, a, b, c))
        else:
            entries.append((batch, np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")))
    if entries:
        key, spot = np.concatenate([e[1] for e in entries]), np.concatenate([e[2] for e in entries])
        source = np.repeat(np.arange(len(entries)), [len(e[1]) for e in entries])
        order = np.argsort(key, kind="stable")
        group = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        hit = (np.bincount(group) > 1) & (np.bincount(group, spot[order] & 1) > 0)
        found = np.sort(order[hit[group]])
        for i, part in zip(*_by(source[found], spot[found] >> 1)):
            out.append((entries[i][0], ENTRY, part.astype("<u4").tobytes(), None, None))
    return pa.Table.from_batches([_rows(out, _BACK)])


def _by(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Values by sorted key."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    parts = np.split(values, edges) if len(keys) else []
    return [int(k) for k in keys[np.concatenate([[0], edges])]] if len(keys) else [], parts


def _collect(table_: pa.Table) -> pa.Table:
    """Flagged places of one batch as bitmaps of its documents."""
    flags, docs = None, None
    places = []
    for kind, a, b in zip(*(_column(table_, n) for n in ("kind", "a", "b"))):
        if kind == TABLE:
            docs = np.frombuffer(a, "<i8").reshape(3, -1)
            flags = np.unpackbits(np.frombuffer(b, np.uint8))[: int(docs[2].sum())]
        else:
            places.append(np.frombuffer(a, "<u4"))
    flags = flags.copy()
    for part in places:
        flags[part] = 1
    rows, at = [], 0
    for key, tag, count in docs.T.tolist():
        part = flags[at : at + count]
        at += count
        if part.any():
            rows.append((key, tag, np.packbits(part).tobytes()))
    return pa.Table.from_batches([_rows(rows, _FLAGS)])


def _flags_of(batch: pa.RecordBatch, counts: np.ndarray) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(batch.column(3).to_pylist(), counts.tolist())]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def _windows(buckets: int, block: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, tags = _keys(batch)
            words, counts = words_of(batch.column(2))
            sums = np.concatenate([[0], np.cumsum(_flags_of(batch, counts))])
            at = inside(counts, window)
            at = at[sums[at + window - block + 1] > sums[at]]
            if not len(at):
                continue
            own = hashes(words)
            one, two = rolling(own, window)[at], rolling(own, window, 1)[at] >> np.uint64(32)
            starts = np.cumsum(counts) - counts
            of = np.searchsorted(starts, at, "right") - 1
            rank = np.empty(len(keys), np.int64)
            rank[np.lexsort((tags, keys))] = np.arange(len(keys))
            same = np.empty(len(keys), np.int64)  # equal (key, tag): one document in several rows
            ordered = np.lexsort((tags, keys))
            same[ordered] = np.cumsum(np.concatenate([[0], (np.diff(keys[ordered]) != 0) | (np.diff(tags[ordered]) != 0)])) if len(ordered) else 0
            start = at - starts[of]
            order = np.lexsort((start, same[of], two, one))
            a, b = one[order], two[order]
            first = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)])
            lead = order[first]
            leads = lead[np.cumsum(first) - 1]
            later = (same[of[order]] != same[of[leads]]) | (start[order] != start[leads])
            local = np.zeros(len(words), np.uint8)
            local[at[order[later]]] = 1
            twin = order[~later & ~first]  # the same place of a repeated row: asks on its own
            lead = np.concatenate([lead, twin])
            number = _batch_id(keys, tags, 2)
            bucket = (one[lead] % np.uint64(buckets)).astype(np.int32)
            sort = np.lexsort((at[lead], bucket))
            ids = np.stack([keys, tags, starts]).astype("<i8").tobytes()
            high = np.stack([one[lead] & np.uint64(0xFFFFFFFF), one[lead] >> np.uint64(32), two[lead]], 1).astype("<u4")
            rows = list(_deal(number, sort, bucket, [high, at[lead].astype("<u4")]))
            rows = [(b_, n_, k_, x, y, ids) for b_, n_, k_, x, y in rows]
            rows.append((int(number % buckets), number, TABLE, np.stack([keys, tags, counts]).astype("<i8").tobytes(), np.packbits(local).tobytes(), None))
            yield _rows(rows, _ROWS)

    return run


def _repeats(table_: pa.Table) -> pa.Table:
    """Occurrences that come after the first one of their window, sent back to their batches."""
    out, entries = [], []
    for batch, kind, a, b, c in zip(*(_column(table_, n) for n in ("batch", "kind", "a", "b", "c"))):
        if kind == TABLE:
            out.append((batch, TABLE, a, b, c))
            continue
        place = np.frombuffer(b, "<u4").astype(np.int64)
        keys, tags, starts = np.frombuffer(c, "<i8").reshape(3, -1)
        of = np.searchsorted(starts, place, "right") - 1
        entries.append((batch, np.frombuffer(a, "<u4").reshape(-1, 3), place, keys[of], tags[of], place - starts[of]))
    if entries:
        high = np.concatenate([e[1] for e in entries])
        one = high[:, 0].astype(np.uint64) | (high[:, 1].astype(np.uint64) << np.uint64(32))
        two, place = high[:, 2], np.concatenate([e[2] for e in entries])
        key, tag, start = (np.concatenate([e[i] for e in entries]) for i in (3, 4, 5))
        source = np.repeat(np.arange(len(entries)), [len(e[2]) for e in entries])
        order = np.lexsort((start, tag, key, two, one))
        first = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)])
        leads = order[first][np.cumsum(first) - 1]
        later = (key[order] != key[leads]) | (tag[order] != tag[leads]) | (start[order] != start[leads])
        found = np.sort(order[later])
        for i, part in zip(*_by(source[found], place[found])):
            out.append((entries[i][0], ENTRY, part.astype("<u4").tobytes(), None, None))
    return pa.Table.from_batches([_rows(out, _BACK)])


def _drop(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, counts = words_of(batch.column(2))
            flags = _flags_of(batch, counts).astype(np.int64)
            covered = np.cumsum(flags)
            covered[window:] -= covered[:-window].copy()  # no window starts within the last words of a text
            gone = covered > 0
            edges = np.cumsum(counts)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], edges])])
            kept = words.filter(pa.array(~gone)).to_pylist()
            ends = np.cumsum(counts - removed).tolist()
            texts = [" ".join(kept[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["key", "tag", "n_removed", "kept"])

    return run


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_parts(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, window: int = WINDOW) -> DataFrame:
    """``(key, tag, n_removed, kept)`` for the documents that lose words; ``kept`` is the remaining text.

    ``tag`` is a hash of the text.  Documents are ordered by key, null keys first, then by tag; rows
    that agree in both are one document.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole aligned block")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(shuffle_width(spark), -(-chars // BUCKET_CHARS))
    width = min(buckets, MOST_PARTITIONS)
    probes = rows.mapInArrow(_probe(buckets, block, window), _DEALT).repartition(width, "bucket")
    hits = stage(probes.groupBy("bucket").applyInArrow(_meet, _BACK_SQL), "hits")
    flags = hits.groupBy("batch").applyInArrow(_collect, "key long, tag long, places binary").groupBy("key", "tag").agg(F.max("places").alias("places"))
    small = F.lit(int(np.iinfo(np.int64).min))
    marked = rows.withColumn("k", F.coalesce("key", small)).join(flags.withColumnRenamed("key", "k"), ["k", "tag"])
    marked = stage(marked.select("key", "tag", "text", "places"), "marked")
    windows = marked.mapInArrow(_windows(buckets, block, window), _DEALT).repartition(width, "bucket")
    later = stage(windows.groupBy("bucket").applyInArrow(_repeats, _BACK_SQL), "repeats")
    gone = later.groupBy("batch").applyInArrow(_collect, "key long, tag long, places binary").groupBy("key", "tag").agg(F.max("places").alias("places"))
    texts = marked.select("key", "tag", "text").dropDuplicates(["key", "tag"]).withColumn("k", F.coalesce("key", small))
    cut = texts.join(gone.withColumnRenamed("key", "k"), ["k", "tag"]).select("key", "tag", "text", "places")
    return cut.mapInArrow(_drop(window), "key long, tag long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, window: int = WINDOW) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` of every row.

    Null texts count as empty.  Rows that agree in key and text are one document, so neither is a
    repeat of the other.  Rows with equal keys and other texts are ordered by a hash of the text.
    Extra columns are ignored; an empty table gives an empty result.
    """
    parts = repeated_parts(docs, key, text, block, window)
    lost = stage(parts.select(F.col("key").alias("k"), F.col("tag").alias("t"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")), "lost")
    words = _words(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).cast("long").alias(key), F.xxhash64(text).alias("tag"), words.alias("words"))
    rows = rows.select(key, "tag", F.size("words").cast("long").alias("n_words"), F.sha2(F.array_join("words", " ").cast("binary"), 256).alias("whole"))
    joined = rows.join(lost, F.col(key).eqNullSafe(F.col("k")) & (F.col("tag") == F.col("t")), "left")
    return joined.select(key, "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return substring_dedup(table(spark, sf_dir, "documents"))
