"""WARC archives with an index: one record per page, read back by sorted and coalesced byte ranges.

Every task writes archives of its own into the shared folder, one gzip member per record, and returns the index:
offset, length, URL and digest of each record.  The index is a table; only archives that it names count, so a task
that is run again leaves at most an archive that nobody reads.  Reading sorts the wanted index rows by archive and
offset, joins neighbouring ranges into one read of a bounded size, and cuts the records out of it.

Equal payloads of at least `MIN_PAYLOAD` bytes are stored once: the page with the smallest id is a response, the
others are revisits of it, which keep the HTTP header but no payload.

Defined cases: null html is an empty payload; a null URL has no target header; a null id is never the smallest, and
its page is a response unless a page with an id has the payload; rows that share the smallest id are all responses;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, modest_batches, utf8, written

MIN_PAYLOAD = 100
# Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
# One read covers records of so many bytes together, and gaps between wanted records up to so many.
READ_BYTES, GAP_BYTES = 4 << 20, 64 << 10
# Archive bytes that one task reads.
TASK_BYTES = 16 << 20

_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile("[\x00-\x20\x7f]")
INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}


def parsed(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); a stored payload is measured and hashed."""
    head, rest = data.split(b"\r\n\r\n", 1)
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha256:")
    size = int(_fields(http)["content-length"])
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record of page {warc.get('warc-page-id')}")
    page, refers = warc.get("warc-page-id"), warc.get("warc-refers-to")
    return page and int(page), size, digest, kind, refers and int(refers.removeprefix("<urn:page:").removesuffix(">"))


def _member(data: bytes) -> bytes:
    made = zlib.compressobj(4, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives; the stored index."""
    modest_batches(pages.sparkSession, 200)
    folder = fresh_path(pages.sparkSession, "archives")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        names = [x.split()[0] for x in INDEX.split(", ")]
        out, path, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, link, payload, digest, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                        out, offset = store.open_output_stream(path, compression=None), 0
                    data = _member(record(page, link, payload, digest, first))
                    out.write(data)
                    rows.append((page, link, digest, "response" if first is None else "revisit", first, path, offset, len(data)))
                    offset += len(data)
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        finally:
            if out is not None:
                out.close()

    payload = utf8(F.col(html))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest")
    )
    # As equal digests mean equal lengths, only long payloads find a partner.
    long_ones = rows.filter(F.octet_length("payload") >= MIN_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Written, so that adaptive execution may split the join on a payload that very many pages have.
    shared = written(long_ones.filter("n > 1").select("digest", "first"), "shared-payloads")
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    rows = rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))
    index = written(rows.mapInArrow(save, INDEX), "archive-index")
    return index.withColumn("store", F.lit(folder))


def _ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) to reads: an archive with the records that one read covers."""
    archive, some = None, []
    for path, offset, length in rows:
        if some:
            end = some[-1][0] + some[-1][1]
            if path != archive or offset - end > GAP_BYTES or offset + length - some[0][0] > READ_BYTES:
                yield archive, some
                some = []
        archive = path
        some.append((offset, length))
    if some:
        yield archive, some


def read(index: DataFrame) -> DataFrame:
    """What the archives hold for some rows of a stored index, see RESULT."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        folders: dict[str, fs.FileSystem] = {}

        def wanted() -> Iterator[tuple[str, int, int]]:
            for batch in batches:
                for folder, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if folder not in folders:
                        folders[folder] = fs.FileSystem.from_uri(folder)[0]
                    yield (folder, row[0]), row[1], row[2]

        opened, file, out = None, None, []
        for (folder, path), some in _ranges(wanted()):
            if opened != path:
                if file is not None:
                    file.close()
                opened, file = path, folders[folder].open_input_file(path)
            first = some[0][0]
            data = file.read_at(some[-1][0] + some[-1][1] - first, first)
            out += [parsed(zlib.decompress(data[a - first : a - first + n], 31)) for a, n in some]
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if file is not None:
            file.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    order = ["store", "archive", "offset"]
    rows = index.select(*order, "length").repartitionByRange(max(1, -(-total // TASK_BYTES)), *order)
    return rows.sortWithinPartitions(*order).mapInArrow(load, RESULT)
