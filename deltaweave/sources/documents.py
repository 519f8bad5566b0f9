"""Documents: composites and models as JSON, traces as Arrow IPC streams, tables as CSV.

Documents are plan data of a bounded size and are read on the driver through Spark's own reader, so any
store that Spark reads will do.  Traces are data: each task reads or writes its own files.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deltaweave.functions import sorts
from deltaweave.operators import flux
from deltaweave.runtime import ship

#: A document above this many bytes is data, and belongs in a table.
MOST_BYTES = 64 << 20


def load(spark: SparkSession, path: str) -> dict:
    """A JSON document; its ``state`` and ``schema`` default to empty."""
    found = spark.read.format("binaryFile").load(path)
    size = found.agg(F.sum("length")).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes; a document has at most {MOST_BYTES}")
    document = json.loads(bytes(found.select("content").first()[0]))
    return {"state": {}, "schema": {}} | document


def save(spark: SparkSession, document: dict, path: str) -> None:
    """Write a JSON document as one file in the folder ``path``; the order of keys is kept, as it decides first matches."""
    text = json.dumps(document)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def sort_of(document: dict) -> sorts.Sort:
    """The document's sort: what its state shows, joined with what its schema declares."""

    def declared(schema) -> sorts.Sort:
        if isinstance(schema, str):
            return sorts.parse(schema)
        return sorts.tree(**{k: declared(v) for k, v in schema.items() if not k.startswith("_")})

    return sorts.resolve(sorts.infer(document["state"]), declared(document["schema"]))


def model(spark: SparkSession, path: str) -> flux.Network:
    """A reaction network from a model document."""
    return flux.network(load(spark, path))


def to_arrow(rows: DataFrame) -> DataFrame:
    """The rows as Arrow IPC streams, one ``(stream binary, n long)`` per Arrow batch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue()], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["stream", "n"])

    return rows.mapInArrow(pack, "stream binary, n long")


def from_arrow(streams: DataFrame, schema: StructType | str) -> DataFrame:
    """The rows that :func:`to_arrow` packed."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column(batch.schema.get_field_index("stream")):
                if stream.is_valid:
                    yield from pa.ipc.open_stream(stream.as_py())

    return streams.mapInArrow(unpack, schema)


def to_csv(rows: DataFrame, path: str) -> None:
    """Write CSV files with headers."""
    rows.write.mode("overwrite").csv(path, header=True)


#: Names of the header of a trace's stream.
NAME, ELEMENT = "trace.name", "trace.element"


def trace_to_arrow(rows: DataFrame, name: str, element: sorts.Sort) -> DataFrame:
    """Frames ``(time double, payload string)`` as Arrow IPC streams whose header tells the trace's name and the sort of its elements."""
    told = {NAME: name, ELEMENT: json.dumps(sorts.as_value(element))}
    schema = pa.schema([pa.field("time", pa.float64(), False), pa.field("payload", pa.string(), False)], told)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, schema) as out:
                out.write_batch(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue()], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["stream", "n"])

    return rows.select(F.col("time").cast("double"), F.coalesce(F.col("payload").cast("string"), F.lit("null")).alias("payload")).mapInArrow(pack, "stream binary, n long")


def trace_from_arrow(streams: DataFrame, wanted: sorts.Sort = sorts.ANY) -> DataFrame:
    """``name, element, time, payload`` of traces' streams; elements that do not refine ``wanted`` are refused before a frame is read."""
    ship(streams.sparkSession)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column(batch.schema.get_field_index("stream")):
                if not stream.is_valid:
                    continue
                reader = pa.ipc.open_stream(stream.as_py())
                header = {k.decode(): v.decode() for k, v in (reader.schema.metadata or {}).items()}
                element = sorts.from_value(json.loads(header[ELEMENT]))
                if not sorts.refines(element, wanted):
                    raise TypeError(f"{element.kind} does not refine {wanted.kind}")
                for part in reader:
                    told = [pa.array([header[k]] * part.num_rows, pa.string()) for k in (NAME, ELEMENT)]
                    yield pa.RecordBatch.from_arrays([*told, part.column(0), part.column(1)], ["name", "element", "time", "payload"])

    return streams.mapInArrow(unpack, "name string, element string, time double, payload string")
