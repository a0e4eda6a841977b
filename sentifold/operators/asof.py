"""Last known value at or before a moment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .segments import ordered, running


def value_as_of(df: DataFrame, keys: Sequence[str], ts: str, value: str, as_of) -> DataFrame:
    """One value per key: the last at or before ``as_of``.  A filter and an aggregate."""
    return df.filter(F.col(ts) <= as_of).groupBy(*keys).agg(F.max_by(value, ts).alias(value))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    tie: Sequence[str] = (),
    unbounded: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Give each left row the last right value of its key at or before its time.

    Both sides become one ordered stream per key, right rows first at equal times, and the value is
    carried forward; no pair of rows is ever formed.  ``unbounded`` is for keys without a natural
    bound on their rows; ``tie`` must then make left rows unique within (keys, ts).
    """
    both = left.withColumn("_side", F.lit(1)).unionByName(
        right.select(*keys, ts, value).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    order = [ts, "_side", *tie]
    if unbounded:
        filled = running(ordered(both, keys, order, limit), {value: ("last", F.col(value))}).rows()
    else:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        filled = both.withColumn(value, F.last(value, ignorenulls=True).over(w))
    return filled.filter("_side = 1").drop("_side")
