"""Benchmark items in documents, by embedding edit distance into Hamming distance.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, in lower-case A-Z.  A window of words is
embedded by a random walk: step j outputs the word it stands on and moves on if bit j of that word's hash says so.
Windows a few edits apart fall into step again soon, so their walks differ in few places, and a sample of
places agrees with a fair chance.  A key is the hash of a sample; `WALKS` walks with `SAMPLES` samples each give the target
recall (measured by a test for items of each size: 0.95 or more at the threshold, 1 for exact copies); the shortest windows
have `SHORT_SAMPLES` samples.

Windows are of `LARGEST` words at most, so that a long item offers many independent ones: an item of n words belongs to the
largest class c (a power of two up to that) with n >= 1.5 c - 1.  A document's windows start at every `stride(c)`-th
word; the item gives the windows at all its offsets, so that both meet in step.

1. Items give keys; the keys mark a bit table of fixed size.
2. The places of documents' windows whose keys are marked (in two tables) go on.
3. They are joined with the items on the key, gathered by document, and the words around them are taken as far as the item
   can reach: its offset at that key says where it would begin.
4. Where enough of the item's words are among them, the edit distance in words of the item to the nearest part of these words is computed; at most `1 - SIMILARITY` of the
   item's words may be edited.

Defined cases: null and empty texts and items match nothing; an item of fewer than five words must occur as it is;
repeated rows give their own results; an empty table gives no rows; other columns are ignored or, by `clean`, carried.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import bit_table, is_set
from .common import modest_batches, unused, utf8, written

SIMILARITY = 0.8
WALKS, SAMPLES, PLACES = 4, 8, 4
# Samples for windows of four words or less, most of whose places an edit touches.
SHORT_SAMPLES = 24
# Words of the largest windows.
LARGEST = 16
# Steps of a walk that are sampled, as a multiple of the window's words.
SPAN = 1.5
# Log2 of the bits that mark the items' keys, and of a smaller table looked at first, which stays in a core's cache.
FILTER_BITS, FIRST_BITS = 26, 20
# Windows that one step of the vectorised walk takes.
AT_ONCE = 200_000
_ODD = 0x9E3779B97F4A7C15
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def stride(size: int) -> int:
    return max(1, size // 4)


def class_of(n_words: int) -> int:
    """The largest class with more than one window of the documents' grid (of four words or more) inside any n consecutive words."""
    size = 1
    while 2 * size <= LARGEST and 3 * size - 1 <= n_words:
        size *= 2
    return size


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(*numbers: int) -> np.uint64:
    out = 1
    for n in numbers:
        out = (out * 4096 + n + 1) * _ODD & (1 << 64) - 1
    return np.uint64(out | 1)


def _n_samples(size: int) -> int:
    return SHORT_SAMPLES if size <= 4 else SAMPLES


def _samples(size: int, walk: int) -> list[list[int]]:
    """The steps whose outputs make up each key: one from each stretch of the walk, so that few fall on one word."""
    steps = max(1, int(SPAN * size))
    rng, n = random.Random(f"{size} {walk}"), min(PLACES, steps)
    cuts = [i * steps // n for i in range(n + 1)]
    return [[rng.randrange(a, b) for a, b in zip(cuts, cuts[1:])] for _ in range(_n_samples(size))]  # noqa: B905


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_keys(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Keys (one row each) of the windows of `size` words that start at `starts` (one column each)."""
    out = np.empty((WALKS * _n_samples(size), len(starts)), np.uint64)
    padded = np.append(hashes, np.zeros(2 * size, np.uint64))
    ends, move = starts + size, np.empty(len(starts), np.uint64)
    for walk in range(WALKS):
        samples = _samples(size, walk)
        kept: dict[int, np.ndarray | None] = {j: None for s in samples for j in s}
        at = starts.copy()
        for j in range(max(kept) + 1):
            if j % 64 == 0:
                bits = _mixed(padded ^ _salt(walk, j // 64))
            if j in kept:  # past its end a window outputs nothing
                kept[j] = np.where(at < ends, padded[at], np.uint64(0)) * _salt(size, walk, j)
            np.take(bits, at, out=move)
            np.right_shift(move, np.uint64(j % 64), out=move)
            np.bitwise_and(move, np.uint64(1), out=move)
            np.add(at, move.view(np.int64), out=at)
        for n, sample in enumerate(samples):
            key = np.full(len(starts), _salt(size, walk, n, 7))
            for j in sample:
                key += kept[j]
            out[walk * len(samples) + n] = _mixed(key)
    return out


def _marks(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _first_marks(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << FIRST_BITS) - 1)).astype(np.int64)


_ITEM_KEY = ["item", "key", "size", "n_words", "first", "last"]


def _item_keys(items: DataFrame) -> DataFrame:
    """(item, key, size, n_words, first, last) of every window of every item: the item's words, the least and greatest offset of the key in it."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if words:
                    size = class_of(len(words))
                    every = window_keys(_hashed(words), np.arange(len(words) - size + 1), size)
                    at = np.tile(np.arange(every.shape[1]), len(every))
                    order = np.lexsort((at, every.ravel()))
                    keys, at = every.ravel()[order], at[order]
                    new = np.append(True, keys[1:] != keys[:-1])
                    first, last = at[new], at[np.append(new[1:], True)]
                    keys = keys[new]
                    same = [np.full(len(keys), x) for x in (size, len(words))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(keys), item), keys.view(np.int64), *same, first, last)], _ITEM_KEY)

    return items.select("item", "text").mapInArrow(make, ", ".join(f"{c} long" for c in _ITEM_KEY))


def _windows(docs: DataFrame, tables: tuple[np.ndarray, np.ndarray], sizes: list[int]) -> DataFrame:
    """(row, at, keys): the documents' windows with marked keys."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # 2 ** FILTER_BITS and 2 ** FIRST_BITS bits

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            rows: list[tuple] = []
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            first = 0
            while first < len(words):  # some documents at a time
                last, n = first, 0
                while last < len(words) and (last == first or n + len(words[last]) <= 1_000_000):
                    n += len(words[last])
                    last += 1
                rows += found(words[first:last], first, *marks)
                first = last
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64()))],
                ["row", "at", "keys"],
            )

    def found(some: list[list[bytes]], first: int, all_marks: np.ndarray, first_marks: np.ndarray) -> list[tuple]:
        counts = np.array([len(w) for w in some])
        bases = np.cumsum(counts) - counts
        hashes = _hashed([w for ws in some for w in ws])
        out = []
        for size in sizes:
            starts = [np.arange(b, b + n - size + 1, stride(size)) for b, n in zip(bases.tolist(), counts.tolist(), strict=True)]
            starts = np.concatenate(starts)
            for i in range(0, len(starts), AT_ONCE):
                part = starts[i : i + AT_ONCE]
                keys = window_keys(hashes, part, size)
                hit = np.zeros(keys.shape, bool)
                for k, row in enumerate(keys):
                    some_hit = np.flatnonzero(is_set(first_marks, _first_marks(row)))
                    hit[k, some_hit] = is_set(all_marks, _marks(row[some_hit]))
                for w in np.flatnonzero(hit.any(axis=0)).tolist():
                    doc = int(np.searchsorted(bases, part[w], side="right")) - 1
                    while counts[doc] == 0:  # an empty document has the same base
                        doc -= 1
                    at = int(part[w] - bases[doc])
                    out.append((first + doc, at, keys[hit[:, w], w].view(np.int64).tolist()))
        return out

    return docs.select("row", "text").mapInArrow(make, "row long, at long, keys array<long>")


def _near(hits: DataFrame) -> DataFrame:
    """(row, doc_id, item, near, near_from): the words of a document around its windows that met an item, as far as it can reach."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (text, met) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words, out, last = words_of(text), [], None
                for item, low, high in sorted((x["item"], max(0, x["low"]), x["high"]) for x in met):
                    if last and last[0] == item and low <= last[2]:
                        last[2] = max(last[2], high)
                    else:
                        last = [item, low, high]
                        out.append(last)
                same = pa.array([n] * len(out), pa.int64())
                items, lows = (pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))
                near = pa.array([b" ".join(words[low:high]) for _, low, high in out], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), items, near, lows], ["row", "doc_id", "item", "near", "near_from"])

    kind = hits.schema["doc_id"].dataType.simpleString()
    return hits.select("row", "doc_id", "text", "met").mapInArrow(make, f"row long, doc_id {kind}, item long, near binary, near_from long")


def nearest(item: list[bytes], words: list[bytes]) -> tuple[int, int]:
    """(distance, end): fewest edits of words that turn the item into a part of `words`, and where that part ends.

    Myers' bit vectors, with the item's words as the bits of a long integer.
    """
    n = len(item)
    at: dict[bytes, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(words):
        eq = at.get(w, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


_NEAREST = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "distance", "end")])


def _nearest(similarity: float) -> Callable:
    """Figures of the nearest part; where more of the item's words are missing than may be edited, the distance is its length."""

    @F.pandas_udf(_NEAREST)
    def found(near: pd.Series, item: pd.Series) -> pd.DataFrame:
        out, known = [], {}
        for a, b in zip(near, item, strict=True):
            words = known.get(b)
            if words is None:
                words = known.setdefault(b, words_of(bytes(b)))
            around = bytes(a).split()
            there = sum(map(set(around).__contains__, words))
            if len(words) - there > int((1 - similarity) * len(words) + 1e-9):
                out.append((len(words), len(words), 0))
            else:
                out.append((len(words), *nearest(words, around)))
        return pd.DataFrame(out, columns=["n_words", "distance", "end"], dtype="int64")

    return found


def _allowed(similarity: float) -> Column:
    return F.floor((1 - F.lit(similarity)) * F.col("n_words") + 1e-9).cast("long")


def _leaks(numbered: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(row, doc_id, item, item_id, n_words, distance, end) from rows (row, doc_id, text) and (item, item_id, text)."""
    items = written(items, "items")
    keys = written(_item_keys(items), "item-keys")
    marks = keys.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("bit"))
    first = keys.select(F.col("key").bitwiseAND(F.lit((1 << FIRST_BITS) - 1).cast("long")).alias("bit"))
    tables = bit_table(marks, "bit", FILTER_BITS), bit_table(first, "bit", FIRST_BITS)
    sizes = sorted(r["size"] for r in keys.select("size").distinct().collect())  # one per power of two
    near = written(_windows(numbered, tables, sizes), "windows")
    met = near.select("row", "at", F.explode("keys").alias("key")).join(keys, "key")
    # The item begins where the window does less its offset, edits and the walk's slack aside, and ends an item's length later.
    slack = _allowed(similarity) + F.col("size")
    low, high = F.col("at") - F.col("last") - slack, F.col("at") - F.col("first") + F.col("n_words") + slack + _allowed(similarity)
    met = met.select("row", F.struct("item", low.alias("low"), high.alias("high")).alias("met"))
    met = written(met.groupBy("row").agg(F.collect_set("met").alias("met")), "met")
    met = written(_near(met.join(numbered, "row")), "near", "zstd")
    met = met.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    met = met.withColumn("match", _nearest(similarity)("near", "item_text")).select(
        "row", "doc_id", "item", "item_id", "match.n_words", "match.distance", (F.col("near_from") + F.col("match.end")).alias("end")
    )
    met = met.filter(F.col("distance") <= _allowed(similarity))
    best = F.min(F.struct("distance", "end", "doc_id", "item_id", "n_words")).alias("best")
    return met.groupBy("row", "item").agg(best).select("row", "item", "best.*")


def _numbered(table: DataFrame, doc_id: str, text: str, number: str, name: str) -> DataFrame:
    return table.select(F.col(doc_id).alias(name), utf8(F.col(text)).alias("text"), F.monotonically_increasing_id().alias(number))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and benchmark item found in it: ids, the item's words, edits, and the word where the nearest part ends."""
    modest_batches(docs.sparkSession)
    found = _leaks(_numbered(docs, doc_id, text, "row", "doc_id"), _numbered(benchmark, item_id, item_text, "item", "item_id"), similarity)
    return found.select("doc_id", "item_id", "n_words", "distance", "end", (1 - F.col("distance") / F.col("n_words")).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, in which no benchmark item is found."""
    modest_batches(docs.sparkSession)
    number = unused(docs, "row_")
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered", "zstd")
    rows = numbered.select(F.col(number).alias("row"), F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("text"))
    found = _leaks(rows, _numbered(benchmark, "item_id", "text", "item", "item_id"), similarity)
    # Written first: where few rows go, as is usual, the join sees so and does not shuffle the texts.
    gone = written(found.select(F.col("row").alias(number)).distinct(), "leaked-rows")
    return numbered.join(gone, number, "left_anti").select(*docs.columns)
