"""Tokens per document in flat token files, found by their separators.

A token file is nothing but ids, each document's followed by the end-of-document id; there is no index.  A file is
read in blocks of a fixed number of ids; a search over each block gives the places of its separators.  A block
knows neither how many documents came before nor where its first one began: a prefix scan over blocks (count and last
place of the separators so far) supplies both.  The scan has two levels, groups of blocks and blocks in a group,
so its windows stay short for files of any size.

`write` makes such files from texts and keeps, as a table, which document is which in its file; `counts` needs the files only.

Defined cases: a null text is empty and has no tokens; ids after the last separator are a document without
end (`ended` is false); repeated rows and null ids are documents like others; an empty table or file gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, modest_batches, written
from .tokens import encoder, public_path

END_ID = 50256
ID_TYPE = "<u2"
# Ids per block, blocks per group of the scan, and ids after which a task begins another file.
BLOCK_IDS, GROUP, FILE_IDS = 1 << 21, 1024, 1 << 28


def write(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write token files below the shared folder; the stored (doc_id, store, file, nth) of every document."""
    modest_batches(docs.sparkSession)
    tokenizer = tokenizer or public_path("byte_bpe_50k.json")
    folder = fresh_path(docs.sparkSession, "token-files")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        enc, end = encoder(tokenizer, True), np.array([END_ID], dtype=ID_TYPE).tobytes()
        out, path, size, nth = None, "", 0, 0
        try:
            for batch in batches:
                paths, places = [], []
                for ids in enc.encode(batch.column(1).to_pylist()):
                    if out is None or size >= FILE_IDS:
                        if out is not None:
                            out.close()
                        path = f"{root}/{uuid.uuid4().hex}.bin"
                        out, size, nth = store.open_output_stream(path), 0, 0
                    out.write(np.frombuffer(ids, dtype="<u4").astype(ID_TYPE).tobytes() + end)
                    paths.append(path)
                    places.append(nth)
                    size += len(ids) // 4 + 1
                    nth += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(paths, pa.string()), pa.array(places, pa.int64())], ["doc_id", "file", "nth"]
                )
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(save, f"doc_id {kind}, file string, nth long"), "token-documents").withColumn("store", F.lit(folder))


def _scanned(files: DataFrame, block_ids: int, end_id: int) -> DataFrame:
    """(file, block, n_ids, ends) of every block; files are rows (store, file)."""
    width = np.dtype(ID_TYPE).itemsize

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stores, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [fs.FileSystem.from_uri(s)[0].get_file_info(f).size // width for s, f in zip(stores, names, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], ["store", "file", "n_all"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for store, name, n_all, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with fs.FileSystem.from_uri(store)[0].open_input_file(name) as file:
                    n = min(block_ids, n_all - block * block_ids)
                    ids = np.frombuffer(file.read_at(n * width, block * block_ids * width), dtype=ID_TYPE)
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    ["file", "block", "n_ids", "ends"],
                )

    sized = files.select("store", "file").mapInArrow(sizes, "store string, file string, n_all long").filter("n_all > 0")
    last = F.floor((F.col("n_all") - 1) / block_ids).cast("long")
    blocks = sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return blocks.repartition("file", "block").mapInArrow(search, "file string, block long, n_ids long, ends array<long>")


def counts(files: DataFrame, block_ids: int = BLOCK_IDS, end_id: int = END_ID) -> DataFrame:
    """(file, nth, start, n_tokens, ended) of every document in the files, rows (store, file)."""
    blocks = written(_scanned(files, block_ids, end_id), "separators")
    base = F.col("block") * block_ids
    blocks = blocks.select(
        "file",
        "block",
        "n_ids",
        "ends",
        F.floor(F.col("block") / GROUP).alias("group"),
        F.size("ends").cast("long").alias("n_ends"),
        (base + F.get("ends", F.size("ends") - 1)).alias("last_end"),
    )
    earlier = (Window.unboundedPreceding, -1)
    groups = blocks.groupBy("file", "group").agg(F.sum("n_ends").alias("n"), F.max("last_end").alias("last"))
    over = Window.partitionBy("file").orderBy("group").rowsBetween(*earlier)
    groups = groups.select("file", "group", F.sum("n").over(over).alias("n_before"), F.max("last").over(over).alias("last_before"))
    over = Window.partitionBy("file", "group").orderBy("block").rowsBetween(*earlier)
    scan = blocks.join(groups, ["file", "group"]).select(
        "file",
        "block",
        "n_ids",
        "ends",
        (F.coalesce("n_before", F.lit(0)) + F.coalesce(F.sum("n_ends").over(over), F.lit(0))).alias("nth_before"),
        F.coalesce(F.greatest("last_before", F.max("last_end").over(over)), F.lit(-1)).alias("end_before"),
    )
    # In each block: the documents that end there, and in a file's last block what has no end.
    n_blocks = blocks.groupBy("file").agg(F.max("block").alias("last_block"))
    scan = scan.join(n_blocks, "file").withColumn("ended_", F.size("ends"))
    over_end = (F.col("block") == F.col("last_block")) & (F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(-1)) < F.col("n_ids") - 1)
    all_ends = F.when(over_end, F.concat("ends", F.array("n_ids"))).otherwise(F.col("ends"))
    rows = scan.select("file", "block", "ends", "ended_", "nth_before", "end_before", F.posexplode(all_ends).alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("end_before") + 1).otherwise(base + F.get("ends", F.col("k") - 1) + 1)
    return rows.select(
        "file",
        (F.col("nth_before") + F.col("k")).alias("nth"),
        start.alias("start"),
        (base + F.col("end") - start).alias("n_tokens"),
        (F.col("k") < F.col("ended_")).alias("ended"),
    )


def document_counts(docs: DataFrame, **options: str) -> DataFrame:
    """(doc_id, n_tokens, start) by way of token files."""
    manifest = write(docs, **options)
    found = counts(manifest.select("store", "file").distinct())
    return manifest.join(found, ["file", "nth"]).select("doc_id", "n_tokens", "start")
