"""Ordered computation over keys of any size.

A plain window puts all rows of a key into one task.  That is the cheapest plan while every key is
small, and it fails when one key owns a third of a large ledger.  So the largest key is counted
first (one narrow scan), and only when it exceeds what a task should hold are rows spread by *range*
over (key, order): each partition then holds a contiguous stretch of rows, a large key covers many
partitions, and a stretch of one key inside one partition is a segment.  A running value is then a
window inside (key, segment) plus a carry computed over one summary row per segment.  A key has at
most as many segments as there are partitions, so the carry window is small whatever the key holds.

The order columns must identify a row within its key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

SEGMENT = "segment"

# Rows of one key that a single task may sort and scan.
ROWS_PER_TASK = 1_000_000

_MERGE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


@dataclass(frozen=True)
class Ordered:
    """Rows with a known order inside each key, cut into segments where a key is too large."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    largest: int
    total: int
    split: bool

    @property
    def parts(self) -> list[str]:
        """Columns of a group that fits one task."""
        return [*self.keys, SEGMENT] if self.split else list(self.keys)

    def rows(self) -> DataFrame:
        return self.df.drop(SEGMENT)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest key and of all keys: counted map-side first, two numbers reach the driver."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, total = counts.agg(F.max("n"), F.sum("n")).first()
    return largest or 0, total or 0


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | None = None) -> Ordered:
    """Order rows by ``order`` inside each key, spreading them by range when a key exceeds ``limit``.

    Spread rows are written once: range bounds come from a sample, so two evaluations could cut the
    rows differently, and every later step must see the same cut.  Their number of partitions follows what a task
    can hold, not ``limit``: the sample for the bounds and the tasks' reports, which reach the driver, grow with it.
    """
    keys, order = tuple(keys), tuple(order)
    limit = ROWS_PER_TASK if limit is None else limit
    largest, total = group_sizes(df, keys)
    if largest <= limit:
        return Ordered(df, keys, order, largest, total, False)
    parts = max(-(-total // max(limit, ROWS_PER_TASK)), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = df.repartitionByRange(parts, *keys, *order).withColumn(SEGMENT, F.spark_partition_id())
    return Ordered(durable(spread), keys, order, largest, total, True)


def running(rows: Ordered, measures: dict[str, tuple[str, Column]]) -> Ordered:
    """Add running values, current row included, over the full order of each key.

    ``measures`` maps an output name to (kind, column) with kind sum, min, max or last.
    """
    inside = (
        Window.partitionBy(*rows.parts).orderBy(*rows.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if not rows.split:
        values = {name: _MERGE[kind][0](column).over(inside) for name, (kind, column) in measures.items()}
        return replace(rows, df=rows.df.withColumns(values))

    earlier = Window.partitionBy(*rows.keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    totals, carries, local, merged = [], [], {}, {}
    for name, (kind, column) in measures.items():
        fold, merge = _MERGE[kind]
        here, before = f"_local_{name}", f"_carry_{name}"
        local[here] = fold(column).over(inside)
        if kind == "last":  # the last value of a segment depends on the row order inside it
            totals.append(F.max_by(column, F.when(column.isNotNull(), F.struct(*rows.order))).alias(name))
        else:
            totals.append(fold(column).alias(name))
        carries.append(fold(F.col(name)).over(earlier).alias(before))
        merged[name] = merge(F.col(before), F.col(here))
    summary = rows.df.groupBy(*rows.parts).agg(*totals).select(*rows.parts, *carries)
    out = rows.df.withColumns(local).join(summary, rows.parts).withColumns(merged)
    return replace(rows, df=out.drop(*local, *(f"_carry_{n}" for n in measures)))


def totals(rows: Ordered, measures: dict[str, tuple[str, Column]]) -> Ordered:
    """Add per-key totals to every row."""
    if not rows.split:
        whole = Window.partitionBy(*rows.keys)
        return replace(rows, df=rows.df.withColumns({n: _MERGE[k][0](c).over(whole) for n, (k, c) in measures.items()}))
    # A large key is summed in the map tasks, and its one row joins back to its many segments.
    partial = rows.df.groupBy(*rows.parts).agg(*(_MERGE[k][0](c).alias(n) for n, (k, c) in measures.items()))
    whole = Window.partitionBy(*rows.keys)
    per_part = partial.select(*rows.parts, *(_MERGE[k][0](F.col(n)).over(whole).alias(n) for n, (k, _) in measures.items()))
    return replace(rows, df=rows.df.join(per_part, rows.parts))


def positions(rows: Ordered, name: str = "pos") -> Ordered:
    """Exact zero-based position of each row within its key (or overall, with no keys)."""
    out = running(rows, {name: ("sum", F.lit(1).cast("long"))})
    return replace(out, df=out.df.withColumn(name, F.col(name) - 1))
