"""Composite scores and the sentiment time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mood import mood_flags, mood_label
from ..operators.blend import composite, total_score
from ..operators.latest import latest
from ..operators.series import with_change, with_ema, with_extreme, with_prior_zscore, with_rolling_stats
from ..operators.stretches import POSITION, in_stretches
from ..params import SOURCE_WEIGHTS, MoodParams
from ..sources.store import append_raw, pack_raw, upsert_composite


def daily_composite(
    raw: DataFrame, order: Sequence[str] = ("ts",), weights: dict[str, float] | None = None
) -> DataFrame:
    """One blended row per symbol and day."""
    return composite(raw.withColumn("day", F.to_date("ts")), ["symbol", "day"], order, weights or SOURCE_WEIGHTS)


def collect_and_publish(scores: DataFrame, raw_path: str, composite_path: str, order: Sequence[str] = ("ts",)) -> None:
    """Append the observations and upsert their composite."""
    known = scores.filter(F.col("source").isin(*SOURCE_WEIGHTS))
    append_raw(pack_raw(known), raw_path)
    blended = composite(known, ["symbol", "ts"], order, SOURCE_WEIGHTS)
    upsert_composite(blended.select("symbol", "ts", "score", "confidence", "source_scores"), composite_path)


def follow(
    total: DataFrame, keys: Sequence[str], order: Sequence[str], p: MoodParams = MoodParams(), position: str | None = None
) -> DataFrame:
    """Average, change, rolling statistics, extreme test, label and flags of a column ``total``."""
    return _after_average(with_ema(total, keys, order, "total", p.alpha), keys, order, p, position)


def _after_average(
    smooth: DataFrame, keys: Sequence[str], order: Sequence[str], p: MoodParams, position: str | None = None
) -> DataFrame:
    """What follows from the last ``stats_rows`` values of a column ``ema``."""
    s = with_change(smooth, keys, order, "ema")
    s = with_rolling_stats(s, keys, order, "ema", p.stats_rows)
    s = with_prior_zscore(s, keys, order, "ema", p.stats_rows, p.min_std)
    s = with_extreme(s, keys, order, "ema", p, position)
    return s.withColumn("label", mood_label(F.col("ema"), p)).withColumn(
        "flags", mood_flags(F.col("ema"), F.col("roc"), p)
    )


def mood_series(raw: DataFrame, order: Sequence[str] = ("ts",), p: MoodParams = MoodParams()) -> DataFrame:
    """The sentiment series per symbol and day.

    Raw rows shrink to one per symbol and day before any window, so a symbol that owns a third of
    the observations still has a short series.
    """
    total = total_score(raw.withColumn("day", F.to_date("ts")), ["symbol", "day"], order, p)
    return follow(total, ["symbol"], ["day"], p)


def mood_by_observation(
    scores: DataFrame,
    order: Sequence[str] = ("ts",),
    p: MoodParams = MoodParams(),
    limit: int | None = None,
) -> DataFrame:
    """The same for every single score (symbol, ..., total), however many a symbol has.

    The average is carried from block to block over the whole key, the rest looks back on a few rows, so the numbers
    do not depend on where a large key is cut.
    """
    average = lambda df, keys: with_ema(df, keys, list(order), "total", p.alpha, position=POSITION)
    work = lambda df, keys: _after_average(df, keys, list(order), p, POSITION)
    return in_stretches(scores, ["symbol"], order, p.stats_rows, work, limit, average)


def mood_state(series: DataFrame, step: str = "day") -> DataFrame:
    """The newest state per symbol, the input of the contrarian signals."""
    slim = series.select(
        "symbol", step, F.col("ema").alias("mood"), "roc", "is_extreme", "extreme_value", "mean_confidence"
    )
    return latest(slim, ["symbol"], [step])


def series_between(series: DataFrame, start=None, end=None, step: str = "day") -> DataFrame:
    """History of the smoothed score between two optional ends, both included."""
    if start is not None:
        series = series.filter(F.col(step) >= start)
    if end is not None:
        series = series.filter(F.col(step) <= end)
    return series
