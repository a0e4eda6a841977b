"""Windows over one ordered series per key.

These use a plain window per key, which is right where the series has a natural bound: one row per
key and day, so a century is 36,525 rows.  The plans reduce raw rows to that grain first.  A series
without such a bound runs the same functions through ``stretches.in_stretches``, ledgers through
``segments``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.mood import extreme_flag, extreme_value
from ..params import MoodParams


def _rows(keys: Sequence[str], order: Sequence[str], first: int, last: int):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(first, last)


def with_ema(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    alpha: float,
    out: str = "ema",
    position: str | None = None,
) -> DataFrame:
    """Exponential moving average seeded by the first value.

    Closed form: inside a block the average is a running sum of x * b^-i scaled back by b^i
    (b = 1 - alpha), so each row costs one addition.  The block length makes b^block = e^-300:
    the scaled terms stay far from overflow, and what a block inherits from two blocks back is
    below any double's precision, hence the carry is just the end of the block before.

    With ``position``, a column that numbers the rows of a key from 0, no window spans more than a block (300 / alpha rows):
    a block's end meets the next block by a join, so a key may have any size.  Both ways add the same terms in the same order.
    """
    if alpha >= 1:
        return df.withColumn(out, F.col(value))
    b = 1.0 - alpha
    block = max(1, int(300 / -math.log(b)))
    row = F.col(position) if position else F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    numbered = df.withColumn("_pos", row.cast("long"))
    i = F.col("_pos") % block
    at = F.floor(F.col("_pos") / block)
    weight = F.when(F.col("_pos") == 0, 1.0).otherwise(alpha)
    term = F.col(value) * weight * F.pow(F.lit(b), -i)
    running = Window.orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if position:
        # A struct is never NULL, so a NULL key joins like any other.
        blocks = numbered.withColumn("_block", F.struct(*keys, at.alias("_at")))
        local = blocks.withColumn("_local", F.pow(F.lit(b), i) * F.sum(term).over(running.partitionBy("_block")))
        following = F.struct(*(F.col(f"_block.{k}") for k in keys), (F.col("_block._at") + 1).alias("_at"))
        ends = local.filter(i == block - 1).select(following.alias("_block"), F.col("_local").alias("_carry"))
        carried = local.join(ends, "_block", "left")
    else:
        before = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
        ends = F.when(i == block - 1, F.col("_local"))
        carried = (
            numbered.withColumn("_block", at)
            .withColumn("_local", F.pow(F.lit(b), i) * F.sum(term).over(running.partitionBy(*keys, "_block")))
            .withColumn("_carry", F.last(ends, ignorenulls=True).over(before))
        )
    inherited = F.coalesce(F.col("_carry") * F.pow(F.lit(b), i + 1), F.lit(0.0))
    return carried.withColumn(out, F.col("_local") + inherited).drop("_pos", "_block", "_local", "_carry")


def with_change(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "roc") -> DataFrame:
    """Difference to the row before; 0 on the first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)))


def with_rolling_stats(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int = 30
) -> DataFrame:
    """Mean, population deviation, least and greatest of the last ``rows`` rows."""
    w = _rows(keys, order, -(rows - 1), 0)
    return df.withColumns(
        {
            "mean": F.avg(value).over(w),
            "std": F.stddev_pop(value).over(w),
            "min": F.min(value).over(w),
            "max": F.max(value).over(w),
        }
    )


def with_prior_zscore(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int = 30, min_std: float = 0.01
) -> DataFrame:
    """Z-score against the rows before the current one; 0 where these hardly vary or are absent."""
    w = _rows(keys, order, -(rows - 1), -1)
    return (
        df.withColumns({"_m": F.avg(value).over(w), "_d": F.stddev_pop(value).over(w)})
        .withColumn(
            "z_score", F.when(F.col("_d") >= min_std, (F.col(value) - F.col("_m")) / F.col("_d")).otherwise(F.lit(0.0))
        )
        .drop("_m", "_d")
    )


def with_extreme(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    smooth: str = "ema",
    p: MoodParams = MoodParams(),
    position: str | None = None,
) -> DataFrame:
    """Extreme test; the rows seen so far are counted, or taken from a column of positions."""
    counted = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows_seen = F.col("rows_seen")
    return (
        df.withColumn("rows_seen", (F.col(position) + 1 if position else counted).cast("long"))
        .withColumn("extreme_value", extreme_value(rows_seen, F.col(smooth), F.col("z_score"), p))
        .withColumn("is_extreme", extreme_flag(rows_seen, F.col("extreme_value"), p))
    )


def with_return(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "close", out: str = "ret"
) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.col(value) / F.lag(value).over(w) - 1)


def _day_number(day: str) -> Column:
    return F.unix_date(F.col(day).cast("date"))


def _moments(column: Column, over: WindowSpec) -> Column:
    """Count, mean and sum of squared departures from the mean, which Spark merges row by row as the frame grows."""
    n = F.count(column).over(over)
    return F.struct(
        n.alias("n"), F.coalesce(F.avg(column).over(over), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(column).over(over) * n, F.lit(0.0)).alias("m2")
    )


def _merged(a: str, b: str) -> Column:
    """The moments of two sets of values from those of each."""
    n, apart = F.col(f"{a}.n") + F.col(f"{b}.n"), F.col(f"{b}.mean") - F.col(f"{a}.mean")
    part = F.col(f"{b}.n") / F.greatest(n, F.lit(1))
    return F.struct(
        n.alias("n"), (F.col(f"{a}.mean") + apart * part).alias("mean"), (F.col(f"{a}.m2") + F.col(f"{b}.m2") + apart * apart * F.col(f"{a}.n") * part).alias("m2")
    )


def with_return_zscore(
    df: DataFrame, keys: Sequence[str], day: str = "day", value: str = "close", lookback_days: int = 252, min_rows: int = 20
) -> DataFrame:
    """Z-score of the latest return among those inside a calendar lookback, current row included; one row per key and day.

    The first close of the lookback has no return of its own, so its return against the close
    before the lookback does not count.  Rows with a short history get NULL.

    Days are cut into blocks as long as the lookback, which then reaches into the block before at most: its moments are those of the
    rows of that block behind its first row, merged with those of the own block so far.  Both grow row by row, so a row costs the
    same whatever the lookback, no sums are subtracted, and equal returns have a variance of exactly 0.
    """
    in_range = Window.partitionBy(*keys).orderBy("_dn").rangeBetween(-lookback_days, 0)
    ahead = Window.partitionBy(*keys, "_block").orderBy("_dn")
    so_far = ahead.rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys, "_block").orderBy(F.col("_dn").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        with_return(df, keys, [day], value)
        .withColumn("_dn", _day_number(day))
        .withColumn("_block", F.floor(F.col("_dn") / (lookback_days + 1)))
        .withColumn("_later", F.when(F.row_number().over(ahead) > 1, F.col("ret")))
        .withColumns({"_own": _moments(F.col("ret"), so_far), "_own_later": _moments(F.col("_later"), so_far), "_rest": _moments(F.col("ret"), behind)})
        .withColumn("_first", F.first(F.struct("_block", "_rest")).over(in_range))
        .withColumn("_before", F.col("_first._rest"))
        .withColumn("_all", F.when(F.col("_first._block") == F.col("_block"), F.col("_own_later")).otherwise(_merged("_before", "_own")))
        .withColumn("_var", F.when(F.col("_all.n") > 1, F.col("_all.m2") / (F.col("_all.n") - 1)))
        .withColumn(
            "z_score",
            F.when((F.col("_all.n") >= min_rows) & (F.col("_var") > 0), (F.col("ret") - F.col("_all.mean")) / F.sqrt("_var")),
        )
        .drop("_dn", "_block", "_later", "_own", "_own_later", "_rest", "_first", "_before", "_all", "_var")
    )


def with_momentum(
    df: DataFrame,
    keys: Sequence[str],
    day: str = "day",
    value: str = "close",
    lookback_days: int = 30,
    fast: int = 5,
    slow: int = 20,
    min_rows: int = 20,
) -> DataFrame:
    """Mean of the last ``fast`` returns minus that of the last ``slow``, inside a calendar lookback.

    Needs ``min_rows`` closes in the lookback; with exactly that many the first close has no return,
    so the slow mean then runs over one return less.
    """
    in_range = Window.partitionBy(*keys).orderBy("_dn").rangeBetween(-lookback_days, 0)
    quick, long_ = _rows(keys, [day], -(fast - 1), 0), _rows(keys, [day], -(slow - 1), 0)
    rest = _rows(keys, [day], -(slow - 2), 0)
    rows = F.col("_rows")
    return (
        with_return(df, keys, [day], value)
        .withColumn("_dn", _day_number(day))
        .withColumns(
            {
                "_rows": F.count(F.lit(1)).over(in_range),
                "_fast": F.avg("ret").over(quick),
                "_slow": F.avg("ret").over(long_),
                "_rest": F.avg("ret").over(rest),
            }
        )
        .withColumn(
            "momentum",
            F.when(rows > slow, F.col("_fast") - F.col("_slow")).when(
                (rows == slow) & (rows >= min_rows), F.col("_fast") - F.col("_rest")
            ),
        )
        .drop("_dn", "_rows", "_fast", "_slow", "_rest")
    )


def with_moving_average(
    df: DataFrame,
    keys: Sequence[str],
    day: str = "day",
    value: str = "close",
    rows: int = 20,
    lookback_days: int = 30,
    out: str = "moving_average",
) -> DataFrame:
    """Mean of the last ``rows`` closes, NULL unless the lookback holds that many."""
    in_range = Window.partitionBy(*keys).orderBy("_dn").rangeBetween(-lookback_days, 0)
    return (
        df.withColumn("_dn", _day_number(day))
        .withColumn(
            out,
            F.when(
                F.count(F.lit(1)).over(in_range) >= rows, F.avg(value).over(_rows(keys, [day], -(rows - 1), 0))
            ),
        )
        .drop("_dn")
    )


def with_drawdown(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], equity: str, initial: float | None = None
) -> DataFrame:
    """Peak so far and the fall from it; the peak starts at the initial capital where one is given."""
    w = _rows(keys, order, Window.unboundedPreceding, 0)
    peak = F.max(equity).over(w)
    if initial is not None:
        peak = F.greatest(peak, F.lit(float(initial)))
    return df.withColumn("peak", peak).withColumn("drawdown", (F.col("peak") - F.col(equity)) / F.col("peak"))


def with_stop(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: float, out: str = "stopped"
) -> DataFrame:
    """True on the rows after the first drawdown at or above the limit."""
    w = _rows(keys, order, Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.max(F.col("drawdown") >= limit).over(w), F.lit(False)))


def cut_after_breach(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: float) -> DataFrame:
    """Keep the rows up to and including the first drawdown at or above the limit."""
    return with_stop(df, keys, order, limit, "_stopped").filter("not _stopped").drop("_stopped")


def with_trend(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "trend") -> DataFrame:
    """Change against the score before, only once more than one earlier score exists."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.when(F.row_number().over(w) > 2, F.col(value) - F.lag(value).over(w)))


def with_confirmation(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], signal_type: str = "signal_type", rows: int = 2
) -> DataFrame:
    """True where the last ``rows`` signals of the key, this one included, share its type."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.lit(True)
    for back in range(1, rows):
        same = same & F.coalesce(F.lag(signal_type, back).over(w) == F.col(signal_type), F.lit(False))
    return df.withColumn("confirmed", same)


def with_enough_rows(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Keys that have at least ``least`` rows, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= least)
