"""Exact medians for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .segments import ROWS_PER_TASK, Ordered, group_sizes, ordered, running, totals

# Ranks of a quantile sketch are off by at most one part in this many; the bracket spans five such parts on either side.
ACCURACY = 10_000
MARGIN = 5

# Groups whose brackets (two values and a name each, some 100 bytes) go to every task.
BROADCAST_GROUPS = 100_000

# Below the bracket, inside it, above it; then by value.
ORDER = ("_side", "_v")


def exact_medians(
    df: DataFrame, key: str, values: Sequence[str], limit: int | None = None, accuracy: int = ACCURACY, margin: int = MARGIN
) -> DataFrame:
    """One row per key with the median of each column, NULLs left out; a column without a value has NULL, a key without any no row.

    While the largest group fits a task, its values are counted, ordered and the one or two middle ones picked.
    Beyond that a mergeable quantile sketch brackets the middle first.  A second pass counts what lies below the bracket and
    above it in the map tasks and moves and orders only the values inside, a thousandth of all.  Those counts also prove
    the bracket: a group whose middle lies outside, as a sketch may be off, has all its values ordered.
    """
    limit = ROWS_PER_TASK if limit is None else limit
    # A struct is never NULL itself, so a NULL key is a group like any other in joins too.
    boxed = df.select(F.struct(F.col(key).alias("key")).alias("_key"), *values)
    long_ = boxed.unpivot(["_key"], list(values), "_name", "_v").filter(F.col("_v").isNotNull())
    keys = ["_key", "_name"]
    largest, total = group_sizes(long_, keys)
    if largest <= limit:
        counts = _counted(long_.withColumn("_side", F.lit(0)), keys)
        middle = _picked(Ordered(counts, tuple(keys), ORDER, largest, total, False))
    else:
        counts = _counted(_bracketed(long_, keys, accuracy, margin), keys)
        inside = _picked(ordered(counts, keys, ORDER, limit))
        middle = durable(inside.select(*keys, "_median", "_found"))
        missed = middle.filter(~F.col("_found")).select(*keys)
        if not missed.isEmpty():
            again = long_.join(missed, keys, "left_semi")
            counts = _counted(again.withColumn("_side", F.lit(0)), keys)
            middle = middle.filter("_found").unionByName(_picked(ordered(counts, keys, ORDER, limit)))
    wide = middle.groupBy("_key").pivot("_name", list(values)).agg(F.first("_median"))
    return wide.select(F.col("_key.key").alias(key), *values)


def _bracketed(long_: DataFrame, keys: list[str], accuracy: int, margin: int) -> DataFrame:
    """The values inside each group's bracket (``_side`` 0); those below (-1) and above (1) without their value."""
    off = margin / accuracy
    ends = F.percentile_approx("_v", [max(0.0, 0.5 - off), min(1.0, 0.5 + off)], accuracy)
    # A sketch depends on the order in which rows come, so every later step reads this one copy.
    ranges = durable(long_.groupBy(*keys).agg(ends.alias("_ends")).select(*keys, F.col("_ends")[0].alias("_lo"), F.col("_ends")[1].alias("_hi")))
    if ranges.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        ranges = F.broadcast(ranges)
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    met = long_.join(ranges, keys).withColumn("_side", side)
    return met.select(*keys, "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_v"))


def _counted(long_: DataFrame, keys: list[str]) -> DataFrame:
    """Equal values are counted before they move."""
    return long_.groupBy(*keys, *ORDER).agg(F.count(F.lit(1)).alias("_n"))


def _picked(counts: Ordered) -> DataFrame:
    """The median of each group, and whether the middle values are known."""
    cum = running(counts, {"_upto": ("sum", F.col("_n"))})
    cum = totals(cum, {"_size": ("sum", F.col("_n"))}).rows()
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
    low, high = F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)
    return (
        cum.filter(holds(low) | holds(high))
        .groupBy(*counts.keys)
        .agg(((F.min("_v") + F.max("_v")) / 2).alias("_median"), F.bool_and(F.col("_side") == 0).alias("_found"))
    )
