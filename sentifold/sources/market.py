"""Reads of bars, fundamentals and universes, as filters the Parquet scan can use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.latest import latest


def in_universe(df: DataFrame, symbols: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the given symbols: a short list is a pushed-down IN, a table is a semi join."""
    if isinstance(symbols, DataFrame):
        return df.join(symbols.select("symbol"), "symbol", "left_semi")
    return df.filter(F.col("symbol").isin(*symbols))


def universe(membership: DataFrame, name: str) -> DataFrame:
    return membership.filter(F.col("universe") == name).select("symbol").distinct()


def bars_between(bars: DataFrame, symbols, start, end, ts: str = "ts") -> DataFrame:
    """Bars of a symbol set, both ends of the time range included."""
    return in_universe(bars, symbols).filter(F.col(ts).between(start, end))


def bars_of(bars: DataFrame, symbol: str, start, end, ts: str = "ts") -> DataFrame:
    return bars.filter((F.col("symbol") == symbol) & F.col(ts).between(start, end))


def in_time_order(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """All symbols merged by time (a range-partitioned sort)."""
    return bars.orderBy(ts, "symbol")


def latest_prices(bars: DataFrame, ts: str = "ts", value: str = "close") -> DataFrame:
    return bars.groupBy("symbol").agg(F.max_by(value, ts).alias("price"))


def daily_closes(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """Last close per symbol and day, the grain the strategies' windows expect."""
    return bars.groupBy("symbol", F.to_date(ts).alias("day")).agg(F.max_by("close", ts).alias("close"))


def trading_dates(bars: DataFrame, day: str = "day") -> DataFrame:
    return bars.select(day).distinct()


def symbols_of(rows: DataFrame) -> DataFrame:
    return rows.select("symbol").distinct()


def latest_time(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Time of the newest row per symbol."""
    return rows.groupBy("symbol").agg(F.max(ts).alias(ts))


def fundamentals_as_of(fundamentals: DataFrame, symbols=None, as_of=None, ts: str = "ts") -> DataFrame:
    """Latest snapshot per symbol, no later than ``as_of`` where one is given."""
    rows = fundamentals if symbols is None else in_universe(fundamentals, symbols)
    if as_of is not None:
        rows = rows.filter(F.col(ts) <= as_of)
    return latest(rows, ["symbol"], [ts])


def resample(bars: DataFrame, unit: str, ts: str = "ts") -> DataFrame:
    """Bars of a longer timeframe.  ``unit`` is a ``date_trunc`` unit or a window length ('5 minutes')."""
    if " " in unit:
        bucket = F.window(F.col(ts).cast("timestamp_ntz"), unit)["start"]
    else:
        bucket = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    return (
        bars.groupBy("symbol", bucket.alias("bucket"))
        .agg(
            F.min_by("open", ts).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", ts).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n_bars"),
        )
    )
