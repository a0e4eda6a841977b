"""Repeated passages by windows of words at sparse suffixes.

Words are runs of characters other than ASCII white space, compared in lower-case A-Z.  Of the suffixes that start
at a word, those at minimisers are retained: in every run of `WINDOW` consecutive `GRAM`-word grams, the place of the
gram with the smallest hash.  Equal passages have equal minimisers, and one of at least `min_words` words has one among its
first `WINDOW` places, with `min_words - WINDOW + 1` words or more to its right.  The first so many words of
a suffix are its key.

1. Count the keys (map tasks combine first).  Keys seen twice are marked in a bit table of fixed size.
2. Every window of `min_words` words has its smallest gram at one of the retained suffixes, and equal windows at the same
   place in them.  Windows whose suffix has a marked key are written with a hash of their words of 128 bits.
3. They are sorted by hash, document and place and dealt out by range, so that a common passage is spread over tasks.  A
   window equal to its neighbour is repeated, one equal to the row before it a copy; the first and last rows of the ranges are
   compared by hash afterwards.

All windows that occur twice are found, without a row per pair.  A word is a copy only if a window over it has an
earlier equal, so each word that is cut stays where that window came first, or, if cut there too, still earlier.  The
windows of a document make whole passages.

Defined cases: a null text has no words; a null id is kept, and copies of it count as later than others; repeated rows are copies
of each other; an empty table gives no rows; other columns are carried along by `without_copies` and ignored elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import bit_table, is_set
from .common import modest_batches, unused, utf8, written

MIN_WORDS = 50
GRAM = 8
WINDOW = 24
# Log2 of the bits that mark repeated keys.
FILTER_BITS = 27
# Windows per range of the sorted order.
ROWS_PER_RANGE = 100_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _gram_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of every GRAM consecutive words, by doubling (GRAM is a power of two)."""
    width = 1
    while width < GRAM:
        words = _mixed(words[:-width] * _ODD + words[width:])
        width *= 2
    return words


def _sliding(values: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """`pick` over every WINDOW consecutive values."""
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        values = pick(values[:-step], values[step:])
        width += step
    return values


class Suffixes:
    """The retained suffixes of some texts that have a whole key to their right: number of the text, place, key.

    The texts are searched as one row of words.  Windows across their borders may retain a few suffixes more;
    keys across them are left out.
    """

    def __init__(self, texts: list[list[bytes]], min_words: int = MIN_WORDS) -> None:
        self.key_words = min_words - WINDOW + 1
        self.min_words = min_words
        sizes = np.array([len(t) for t in texts], np.int64)
        total = int(sizes.sum())
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.places = self.text = np.empty(0, np.int64)
        self.keys = np.empty(0, np.uint64)
        if total < GRAM + WINDOW:
            return
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, (w for t in texts for w in t)), np.uint64, total)
        self.grams = _gram_hashes(hashes)
        self.least = _sliding(self.grams, np.minimum)
        # A gram is the least of some window around it if the greatest of these windows' least is the gram itself.
        edge = np.zeros(WINDOW - 1, np.uint64)
        around = _sliding(np.concatenate([edge, self.least, edge]), np.maximum)
        places = np.flatnonzero(around == self.grams)
        text = np.searchsorted(self.ends, places, side="right")
        inside = places + self.key_words <= self.ends[text]
        self.text, self.places = text[inside], places[inside]
        self.keys = self._hashed(self.places, self.key_words, _ODD)

    def _hashed(self, places: np.ndarray, n_words: int, factor: np.uint64) -> np.ndarray:
        """Hash of the words that start at some places."""
        out = np.zeros(len(places), np.uint64)
        for offset in (*range(0, n_words - GRAM, GRAM), n_words - GRAM):
            out = _mixed(out * factor + self.grams[places + offset])
        return out

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, hash, other hash) of the windows of `min_words` words whose smallest gram is at a chosen suffix."""
        at, text = self.places[chosen], self.text[chosen]
        found = [np.empty(0, np.int64)]
        for left in range(WINDOW):
            start = at - left
            start = start[(start >= self.begins[text]) & (start + self.min_words <= self.ends[text])]
            found.append(start[self.least[start] == self.grams[start + left]])
        starts = np.unique(np.concatenate(found))
        text = np.searchsorted(self.ends, starts, side="right")
        return text, starts - self.begins[text], *(self._hashed(starts, self.min_words, f) for f in (_ODD, _OTHER))


def _repeated_keys(docs: DataFrame, min_words: int, bits: int) -> np.ndarray:
    """Bit table of the keys that occur twice or more."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Suffixes([words_of(t) for t in batch.column(0).to_pylist()], min_words).keys
            key, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    counts = docs.select("text").mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    marked = counts.filter("n > 1").select(F.shiftrightunsigned("key", 64 - bits).alias("bit"))
    return bit_table(marked, "bit", bits)


def _windows(docs: DataFrame, table: np.ndarray, min_words: int, bits: int) -> DataFrame:
    """Windows at suffixes with a marked key: numbered document, place and the two hashes of their words."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 2 ** bits bits

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            suffixes = Suffixes([words_of(t) for t in batch.column(1).to_pylist()], min_words)
            hit = is_set(marks, (suffixes.keys >> np.uint64(64 - bits)).astype(np.int64))
            if not hit.any():
                continue
            text, places, one, other = suffixes.windows(hit)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(text)),
                    batch.column(2).take(pa.array(text)),
                    pa.array(places),
                    pa.array(one.view(np.int64)),
                    pa.array(other.view(np.int64)),
                ],
                ["doc_id", "row", "place", "one", "other"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "row").mapInArrow(windows, f"doc_id {kind}, row long, place long, one long, other long")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows of one range to the repeated ones and, whatever they are, its first and last (`edge`)."""

    def told(batch: pa.RecordBatch, before: tuple | None, after: tuple | None) -> pa.RecordBatch:
        one, other = (batch.column(n).to_numpy() for n in ("one", "other"))
        same = (one[1:] == one[:-1]) & (other[1:] == other[:-1])
        copy = np.concatenate([[before == (one[0], other[0])], same])
        repeated = copy | np.concatenate([same, [after == (one[-1], other[-1])]])
        edge = np.zeros(len(one), bool)
        edge[0] |= before is None
        edge[-1] |= after is None
        keep = pa.array(repeated | edge)
        names = ["doc_id", "row", "place", "one", "other", "copy", "repeated", "edge"]
        columns = [*(batch.column(n) for n in names[:3]), *(pa.array(x, mask=~edge) for x in (one, other)), *map(pa.array, (copy, repeated, edge))]
        return pa.RecordBatch.from_arrays(columns, names).filter(keep)

    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield told(held, before, (batch.column("one")[0].as_py(), batch.column("other")[0].as_py()))
            before = held.column("one")[-1].as_py(), held.column("other")[-1].as_py()
        held = batch
    if held is not None:
        yield told(held, before, None)


def _repeated_windows(windows: DataFrame, rows_per_range: int) -> DataFrame:
    """(row, doc_id, place, copy) of every window that occurs twice or more; `copy` if not the first."""
    n_ranges = max(1, windows.count() // rows_per_range)
    order = [F.col("one"), F.col("other"), F.col("doc_id").asc_nulls_last(), F.col("row"), F.col("place")]
    ranges = windows.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
    kind = windows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, place long, one long, other long, copy boolean, repeated boolean, edge boolean"
    made = written(ranges.mapInArrow(_compared, schema), "repeated-windows")
    columns = ["row", "doc_id", "place", "copy"]
    # The rows between two ranges of one window are the last of the one and the first of the other.
    edges = made.filter("edge")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "place")
    met = written(edges.groupBy("one", "other").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "range-edges")
    edges = edges.join(met, ["one", "other"], "left").filter("repeated OR first IS NOT NULL")
    is_first = (F.col("first.row") == F.col("row")) & (F.col("first.place") == F.col("place"))
    edges = edges.withColumn("copy", F.col("copy") | F.coalesce(~is_first, F.lit(False)))
    return made.filter("repeated AND NOT edge").select(*columns).unionByName(edges.select(*columns))


_SPANS = T.ArrayType(T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
_BOTH = T.StructType([T.StructField("repeated", _SPANS), T.StructField("copies", _SPANS)])


def _merged(places: np.ndarray, min_words: int) -> list[dict[str, int]]:
    """Overlapping and touching windows become one span."""
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) > min_words)
    low, high = places[np.concatenate([[0], cuts + 1])], places[np.concatenate([cuts, [-1]])] + min_words
    return [{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)]


def repeated_spans(numbered: DataFrame, min_words: int = MIN_WORDS, bits: int = FILTER_BITS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(row, doc_id, repeated, copies) of documents with repeated passages, from rows (row, doc_id, text).

    `repeated` are the spans of words (from, to before) that occur elsewhere too, `copies` those of them that are
    not the first occurrence.
    """
    table = _repeated_keys(numbered, min_words, bits)
    windows = written(_windows(numbered, table, min_words, bits), "windows")
    found = _repeated_windows(windows, rows_per_range)

    @F.pandas_udf(_BOTH)
    def spans(marks: pd.Series) -> pd.DataFrame:
        marks = [np.sort(m) for m in marks]
        every = [_merged(m >> 1, min_words) for m in marks]
        return pd.DataFrame({"repeated": every, "copies": [_merged(m[m & 1 == 1] >> 1, min_words) for m in marks]})

    marks = F.collect_list(F.col("place") * 2 + F.col("copy").cast("long"))
    per_doc = found.groupBy("row", "doc_id").agg(marks.alias("marks"))
    return per_doc.select("row", "doc_id", spans("marks").alias("spans")).select("row", "doc_id", "spans.repeated", "spans.copies")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """One row per document with a repeated passage: doc_id, `repeated` and `copies` (see `repeated_spans`)."""
    modest_batches(docs.sparkSession)
    numbered = docs.select(F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("text"), F.monotonically_increasing_id().alias("row"))
    return repeated_spans(numbered, **options).drop("row")


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text less some spans of its words; white space before a removed word goes with it."""
    starts = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", text)]
    out, at = [], 0
    for low, high in spans:
        out.append(text[at : starts[low - 1][1] if low else 0])
        at = starts[high - 1][1]
    out.append(text[at:])
    return b"".join(out)


@F.pandas_udf(T.BinaryType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    cut = [None if t is None else _without(bytes(t), [(x["low"], x["high"]) for x in s]) for t, s in zip(texts, spans, strict=True)]
    return pd.Series(cut, dtype=object)


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows with every copy of a passage cut from its text; rows left without a word go."""
    modest_batches(docs.sparkSession)
    number, spans = unused(docs, "row_"), unused(docs, "cut_")
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered", "zstd")
    rows = numbered.select(F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("text"), F.col(number).alias("row"))
    cuts = repeated_spans(rows, **options).filter(F.size("copies") > 0)
    joined = numbered.join(cuts.select(F.col("row").alias(number), F.col("copies").alias(spans)), number, "left")
    # Texts without a cut do not go to Python.
    is_cut = F.col(spans).isNotNull()
    short = _cut(F.when(is_cut, utf8(F.col(text))), F.col(spans)).cast("string")
    joined = joined.withColumn(text, F.when(is_cut, short).otherwise(F.col(text)))
    return joined.filter(~is_cut | F.col(text).rlike(r"[^ \t\n\r\x0b\f]")).select(*docs.columns)
