"""Archives read back against the pages that were written."""

import gzip
import hashlib
import random

from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentifold.llm import warc

SCHEMA = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType())]
)


def plain(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= warc.MIN_PAYLOAD and i is not None:
            first[data] = min(first.get(data, i), i)
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        to = None if to == i else to
        yield i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def corpus():
    rng = random.Random(1)
    html = ["<p>" + "é x\r\n\r\n" * rng.randrange(60) for _ in range(40)] + ["a" * 99, "a" * 100, "é" * 50, "", None, "long " * 500_000]
    rows = [(i, f"http://h/{i}", rng.choice(html)) for i in rng.sample(range(1000), 300)]
    rows += [(2000, None, "x" * 200), (2001, "http://a b\r\nEvil: 1", "x" * 200), (None, None, "x" * 200), (None, "u", "only here " * 20)]
    return rows + [(3000, "u", "dup " * 50)] * 2 + [(3001, "u", "dup " * 50), (5, "u", "long " * 500_000)]


def test_round_trip(spark):
    rows = corpus()
    index = warc.write(frame(spark, rows))
    got = [tuple(r) for r in warc.read(index).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_selected_records_and_valid_gzip(spark):
    rows = corpus()
    index = warc.write(frame(spark, rows))
    some = index.filter(F.col("page_id") % 7 == 0)
    want = [x for x in plain(rows) if x[0] is not None and x[0] % 7 == 0]
    assert sorted((tuple(r) for r in warc.read(some).collect()), key=str) == sorted(want, key=str)
    one = index.first()
    store, _ = fs.FileSystem.from_uri(one["store"])
    whole = gzip.decompress(store.open_input_file(one["archive"]).read())
    assert whole.count(b"WARC/1.1\r\n") == index.filter(F.col("archive") == one["archive"]).count()
    assert b"\r\nEvil: 1" not in whole


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP_BYTES + 1, 5), ("b", 0, 5), ("b", 5, warc.READ_BYTES), ("b", 5 + warc.READ_BYTES, 1)]
    assert [(a, len(s)) for a, s in warc._ranges(iter(rows))] == [("a", 2), ("a", 1), ("b", 1), ("b", 1), ("b", 1)]


def test_empty_table(spark):
    assert warc.read(warc.write(frame(spark, []))).collect() == []
