"""Rows of a stream whose time is new to their key, with little state.

A deduplication that keeps a state row per bar grows by a key, a time and the store's overhead for each.  Bars stand at even
distances, so the times of a key are kept as run lengths of their steps instead: a pair of numbers for each trading day of minute bars.
Times at uneven distances cost two numbers each.  A state row holds the keys of a bucket (see ``buckets``) and a span of days.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .buckets import BUCKETS, ROWS_AT_ONCE, from_bytes, in_buckets, out_of_buckets, to_bytes
from .held import keep_state_in_rocksdb

DAY_US = 86_400_000_000
SPAN_DAYS = 3660

# A time that no row has stands for NULL, which is a time of its own.
NO_TIME = -(2**62)

_KEY, _AT = "key", "at"
_NESTED = (T.BinaryType, T.ArrayType, T.MapType, T.StructType)


def packed(times: np.ndarray) -> bytes:
    """Ascending times, of one key after the other, as the first one and (step, how often) pairs."""
    steps = np.diff(times)
    starts = np.flatnonzero(np.concatenate([[True], steps[1:] != steps[:-1]])) if len(steps) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(steps)))
    return np.concatenate([times[:1], np.column_stack([steps[starts], counts]).ravel()]).astype("<i8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The inverse of ``packed``."""
    numbers = np.frombuffer(data, "<i8")
    steps = np.repeat(numbers[1::2], numbers[2::2])
    return np.concatenate([numbers[:1], numbers[0] + np.cumsum(steps)])


class _Span:
    """The times of a bucket's keys within a span: key i has ``counts[i]`` of ``times``; ``added`` is when it got the last, by the clock."""

    def __init__(self, stored: tuple | None, now: int, forget_ms: int | None):
        self.now = now
        self.names, self.counts, self.added, self.times = np.empty(0, object), *np.empty((3, 0), np.int64)
        if stored is None:
            return
        row = from_bytes([bytes(stored[0])])
        self.names = row.column("names").chunk(0).flatten().to_numpy(zero_copy_only=False)
        self.counts, self.added = (row.column(c).chunk(0).flatten().to_numpy() for c in ("counts", "added"))
        self.times = unpacked(row.column("times")[0].as_py())
        if forget_ms is not None:
            known = now < self.added + forget_ms
            self.times = self.times[np.repeat(known, self.counts)]
            self.names, self.counts, self.added = self.names[known], self.counts[known], self.added[known]

    def add(self, names: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Which times are new to their key, the first of equal ones."""
        codes, self.names = pd.factorize(np.concatenate([self.names, names]), use_na_sentinel=False)
        known, n = len(self.counts), len(self.times)
        codes, times = np.append(np.repeat(np.arange(known), self.counts), codes[known:]), np.append(self.times, times)
        order = np.lexsort((times, codes))  # stable: what is known comes first
        codes, times = codes[order], times[order]
        first = np.append(True, (codes[1:] != codes[:-1]) | (times[1:] != times[:-1]))
        self.times, self.counts = times[first], np.bincount(codes[first], minlength=len(self.names))
        fresh = order[first]
        self.added = np.append(self.added, np.full(len(self.names) - known, self.now))
        self.added[codes[first][fresh >= n]] = self.now
        return np.sort(fresh[fresh >= n]) - n

    def stored(self) -> bytes:
        lists = {"names": pa.array(self.names, pa.string(), from_pandas=True), "counts": pa.array(self.counts), "added": pa.array(self.added)}
        row = {c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for c, x in lists.items()}
        return to_bytes(pa.table(row | {"times": pa.array([packed(self.times)], pa.large_binary())}))


class FirstOfEachTime(StatefulProcessor):
    """Hands on the first row of each time of a key."""

    def __init__(self, span_us: int, forget_ms: int | None):
        self.span_us, self.forget_ms = span_us, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "span bigint", "times binary", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = 0 if self.forget_ms is None else timerValues.getCurrentProcessingTimeInMs()
        table = from_bytes([bytes(part) for frame in rows for part in frame["rows"]])
        names, at = table.column(_KEY).to_numpy(), table.column(_AT).to_numpy()
        spans, fresh = at // self.span_us, []
        for span in np.unique(spans).tolist():
            known, here = _Span(self.seen.getValue((span,)), now, self.forget_ms), np.flatnonzero(spans == span)
            new = known.add(names[here], at[here])
            if len(new):
                fresh.append(here[new])
                self.seen.updateValue((span,), (known.stored(),))
        if fresh:
            out = table.drop_columns([_KEY, _AT]).take(np.sort(np.concatenate(fresh)))
            yield pd.DataFrame({"rows": [to_bytes(out.slice(a, ROWS_AT_ONCE)) for a in range(0, out.num_rows, ROWS_AT_ONCE)]})

    def close(self) -> None:
        pass


def _key(fields: Sequence[tuple[T.StructField, str]]) -> Column:
    """The key's columns as one text, equal for equal keys only; NULLs are values of their own."""
    if len(fields) == 1 and not isinstance(fields[0][0].dataType, _NESTED):
        return F.col(fields[0][1]).cast("string")
    return F.to_json(F.struct(*(F.col(n) if isinstance(f.dataType, _NESTED) else F.col(n).cast("string") for f, n in fields)))


def first_of_each_time(
    rows: DataFrame, keys: Sequence[str], ts: str, span_days: int = SPAN_DAYS, forget_days: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """The first row of each time of a key, whenever it and its repeats come; other columns come out as they went in.

    NULL keys and a NULL time count as values.  Which of several rows of one micro-batch is first is open.
    ``span_days`` bounds what a batch rewrites for a bucket: uneven times want shorter spans.  With ``forget_days`` a
    span of a key to which nothing was added for so long (by the clock) is dropped, and a repeat after that comes out again: a choice of the caller.
    """
    keep_state_in_rocksdb(rows.sparkSession)
    # Names of our own on the way, which no column clashes with.
    names = {f"c{i}": f for i, f in enumerate(rows.schema.fields)}
    at = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(NO_TIME)).alias(_AT)
    there = rows.select(*(F.col(f"`{f.name}`").alias(n) for n, f in names.items()), at)
    there = there.withColumn(_KEY, _key([(f, n) for n, f in names.items() if f.name in keys]))
    work = FirstOfEachTime(span_days * DAY_US, None if forget_days is None else forget_days * DAY_US // 1000)
    mode = "none" if forget_days is None else "processingTime"
    first = in_buckets(there, F.col(_KEY), buckets).transformWithStateInPandas(work, "rows binary", "append", mode)
    first = out_of_buckets(first, T.StructType([T.StructField(n, f.dataType) for n, f in names.items()]))
    return first.select(*(F.col(n).alias(f.name) for n, f in names.items()))
