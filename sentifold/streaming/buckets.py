"""Rows of a stream in buckets of keys, so that Python and the state store are called once a bucket and not once a key.

A call for each key takes some milliseconds whatever it does.  Here keys fall into ``BUCKETS`` by hash; the map tasks sort their
rows by bucket and hand each bucket's on as one Arrow table in a binary column, which keeps every type and NULL as it is.  State is
kept per bucket, as Arrow tables too.  The number of buckets belongs to a stream's checkpoint: a stream goes on with the number it began with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

BUCKETS = 128

# Rows and bytes that a map task sorts at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 250_000, 64 << 20

_BUCKET = "bucket"


def to_bytes(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write(table)
    return sink.getvalue().to_pybytes()


def from_bytes(parts: list[bytes]) -> pa.Table:
    """The tables' rows as one table, whose columns are in one piece."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in parts]).combine_chunks()


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, the last column of which is their bucket, as (bucket, rows)."""

    def cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        at = table.column(_BUCKET).to_numpy()
        order = np.argsort(at, kind="stable")
        at, table = at[order], table.drop_columns([_BUCKET]).take(order).combine_chunks()
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        parts = [to_bytes(table.slice(a, b - a)) for a, b in zip(starts, np.append(starts[1:], len(at)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(at[starts], pa.int32()), pa.array(parts, pa.binary())], [_BUCKET, "rows"])

    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
        if rows >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
            yield cut(held)
            held, rows, size = [], 0, 0
    if held:
        yield cut(held)


def _out_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.column(0):
            yield from pa.ipc.open_stream(part.as_py()).read_all().to_batches()


def in_buckets(rows: DataFrame, key: Column, buckets: int = BUCKETS) -> GroupedData:
    """Rows grouped by the bucket of their key: a column ``rows`` holds them as bytes; no column of theirs may be called ``bucket``."""
    marked = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    return marked.mapInArrow(_in_buckets, f"{_BUCKET} int, rows binary").groupBy(_BUCKET)


def out_of_buckets(parts: DataFrame, schema) -> DataFrame:
    """The rows of a column ``rows`` of bytes."""
    return parts.select("rows").mapInArrow(_out_of_buckets, schema)
