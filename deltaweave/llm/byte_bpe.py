"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts up to ``CHUNK`` characters are encoded as they are.  A longer text is cut, inside the JVM,
into chunks that overlap by ``OVERLAP`` characters and are dealt over all tasks.  The cuts fall
anywhere, so a chunk's first and last pre-tokens may be wrong; but pre-tokenisation resynchronises
at every character that is followed by white space and is none itself, since no pre-token holds
such a pair (`` ?\\p{L}+`` and its kin take white space only in front, ``\\s+`` takes nothing else).
Each chunk therefore owns the text from the first such place after its start up to the first
such place at or after its end, which it finds in the overlap, and encodes just that piece; the
pieces' ids are concatenated in order.  If an overlap holds no such place, the chunk asks for the
whole document to be encoded at once: exact, only slower.

Decoding concatenates the ranks' raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.tokens import slices
from deltaweave.runtime import ship, stage, table

CHUNK, OVERLAP = 1 << 16, 1 << 10
#: White space on which every regex engine agrees; resynchronising at fewer places is safe.
SPACES = " \t\n\r"


class ByteBpe:
    """Ranks of a tiktoken file with its pre-tokenisation pattern."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        most = max(self.ranks.values()) + 1
        self.raw = [b""] * most
        for raw, rank in self.ranks.items():
            self.raw[rank] = raw
        self.names = [str(i) for i in range(most)]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        """The raw bytes of the ids, concatenated."""
        raw = self.raw
        return b"".join([raw[i] for i in ids])

    def digests(self, ids) -> tuple[int, str, str]:
        names = self.names
        shown = ",".join([names[i] for i in ids])
        return len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


_codecs: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """This worker's codec."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBpe(path, pattern)
    return _codecs[path, pattern]


def sync(text: str, at: int) -> int | None:
    """The first place from ``at`` on where a non-space is followed by white space; None if there is none."""
    spaces = [i for i in (text.find(c, max(at, 1)) for c in SPACES) if i >= 0]
    while spaces:
        place = min(spaces)
        if not text[place - 1].isspace() and not "\x1c" <= text[place - 1] <= "\x1f":
            return place
        spaces = [i for i in (text.find(c, place + 1) for c in SPACES) if i >= 0]
    return None


def own_piece(text: str, first: bool, last: bool, chunk: int) -> str | None:
    """The part of a chunk's text (with overlap) that the chunk encodes; None if it can't tell."""
    start, end = 0 if first else sync(text, 1), len(text) if last else sync(text, chunk + 1)
    if start is None or end is None or start > end:
        return None
    return text[start:end]


_SHORT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _whole(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches):
            done = [own.digests(own.encode(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _chunks(path: str, pattern: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches):
            ids = []
            for number, many, text in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                piece = own_piece(text, number == 0, number == many - 1, chunk)
                ids.append(None if piece is None else np.asarray(own.encode(piece), "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], ["row", "doc_id", "number", "many", "ids"])

    return run


def _stitch(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            done = [own.digests(np.frombuffer(b"".join(parts), "<u4").tolist()) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def byte_bpe(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null texts count as empty (no tokens).  Repeated rows, null keys and extra columns of any name are
    allowed; one row comes back for each row, none for an empty table.
    """
    if overlap > chunk:
        raise ValueError("chunks may overlap by their own length at most")
    ship(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    long_ = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = source.where(~long_).mapInArrow(_whole(path, pattern), _SHORT)
    many = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    cut = source.where(long_).withColumn("row", F.monotonically_increasing_id()).withColumn("many", many)
    pieces = cut.select("row", "doc_id", "many", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}+"), F.lit(0)).alias("pieces"))  # one pass over the text
    tail = lambda i: F.substring(F.coalesce(F.get("pieces", i + 1), F.lit("")), F.lit(1), F.lit(overlap))
    parts = pieces.select("row", "doc_id", "many", F.posexplode(F.transform("pieces", lambda piece, i: F.concat(piece, tail(i)))).alias("number", "part"))
    parts = parts.select("row", "doc_id", "number", "many", F.col("part").alias("text")).repartition("row", "number")
    coded = stage(parts.mapInArrow(_chunks(path, pattern, chunk), "row long, doc_id long, number int, many int, ids binary"), "chunks")
    grouped = coded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("ids").alias("n"), F.first("many").alias("many"), F.sort_array(F.collect_list(F.struct("number", "ids"))).alias("parts"))
    stitched = grouped.where("n = many").select("doc_id", F.col("parts.ids").alias("parts")).mapInArrow(_stitch(path, pattern), _SHORT)
    out = short.unionAll(stitched)
    lost = coded.where("ids IS NULL").select("row").distinct()
    if not lost.isEmpty():
        out = out.unionAll(cut.join(lost, "row", "left_semi").select("doc_id", "text").mapInArrow(_whole(path, pattern), _SHORT))
    return out


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
