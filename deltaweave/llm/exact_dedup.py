"""Exact dedup with a heavy-hitter split.

1. Every text is reduced to its SHA-256 digest inside the JVM; only ``(row key, digest)`` is kept.
2. A Misra-Gries summary of each partition finds digests that may be frequent; the summaries are
   merged by summing, and the ``capacity`` largest sums are candidates.  No digest of more than
   1/(capacity+1) of all rows can be missed: each summary has lost at most 1/(capacity+1) of the rows
   that it does not hold, so such a digest's sum exceeds the (capacity+1)-th largest.
3. The candidates are counted exactly (a broadcast semi join and a map-side combined aggregate)
   and only verified winners are kept.
4. Winners are broadcast: their rows get their answer on the map side and are never shuffled.
   All other digests are aggregated with map-side combination and joined back, so no task holds
   the rows of a group.

The broadcast is bounded by ``capacity`` rows of about 80 bytes, whatever the input size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.runtime import ship, stage, table

#: Counters of one partition's summary, and the most winners that are broadcast.
CAPACITY = 512
#: Winners must hold at least this many rows; smaller groups shuffle like any other.
LEAST_HEAVY = 64


def misra_gries(items: Iterator[bytes], capacity: int) -> dict[bytes, int]:
    """Frequent-item summary: every item with more than n/(capacity+1) occurrences is in it."""
    counts: dict[bytes, int] = {}
    for item in items:
        if item in counts:
            counts[item] += 1
        elif len(counts) < capacity:
            counts[item] = 1
        else:
            for key in [k for k, v in counts.items() if v == 1]:
                del counts[key]
            for key in counts:
                counts[key] -= 1
    return counts


def _summaries(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = misra_gries((x for b in batches for x in b.column(0).to_pylist()), capacity)
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([v for _, v in rows], pa.int64())], ["digest", "n"])

    return run


def heavy_winners(digests: DataFrame, key: str, capacity: int = CAPACITY, least: int = LEAST_HEAVY) -> DataFrame:
    """``(digest, keep_id, group_size)`` of verified frequent digests, at most ``capacity`` rows.

    Rows beyond ``capacity`` are not lost: their digests simply take the ordinary path.
    """
    ship(digests.sparkSession)
    found = digests.select("digest").mapInArrow(_summaries(capacity), "digest binary, n long")
    candidates = found.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(capacity).select("digest")
    counted = digests.join(F.broadcast(candidates), "digest").groupBy("digest")
    verified = counted.agg(F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return stage(verified.where(F.col("group_size") >= least), "winners")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, least: int = LEAST_HEAVY) -> DataFrame:
    """One row per input row: ``key, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as empty, so null and empty texts form one group.
    Of equal texts the row with the largest key stays.  Repeated rows with the same key and text
    are one document in several copies: each counts in ``group_size`` and all have ``kept`` true
    if they hold the largest key.  A null key never wins over another key; a group of only null
    keys keeps no id and its rows have ``kept`` true.  Extra columns of any name are ignored.  An
    empty table gives an empty result.
    """
    digests = stage(docs.select(F.col(key).alias("id"), _digest(F.col(text)).alias("digest")), "digests")
    winners = heavy_winners(digests, "id", capacity, least)
    tagged = digests.join(F.broadcast(winners), "digest", "left")
    heavy = tagged.where("group_size IS NOT NULL")
    light = tagged.where("group_size IS NULL").select("id", "digest")
    groups = light.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rows = heavy.select("id", "digest", "keep_id", "group_size").unionAll(light.join(groups, "digest").select("id", "digest", "keep_id", "group_size"))
    return rows.select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text stays under a larger key; columns of any name and repeated rows as they are.

    Null and empty texts are one group; a group of only null keys stays whole.
    """
    found = exact_dedup(docs.select(F.col(key).alias("id"), F.col(text).alias("body")), "id", "body")
    gone = found.where(~F.col("kept")).select("id", F.unhex("text_sha256").alias("digest")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("id"), _digest(F.col(text)).alias("digest"))
    return own.alias("a").join(gone.alias("b"), F.expr("a.id <=> b.id AND a.digest = b.digest"), "left_anti").select(*[F.col("a.row")[c].alias(c) for c in docs.columns])
