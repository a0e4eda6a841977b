"""Sentiment formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import MoodParams
from .basic import clip, or_zero

TINY = 1e-8
# Typical margin balance and typical daily volume.
TYPICAL_BALANCE = 10_000_000.0
TYPICAL_VOLUME = 10_000_000.0


def rescale(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Clip to [low, high] and map that range onto [-1, 1]."""
    return 2 * (clip(x, low, high) - low) / (high - low) - 1


def weighted(x: Column, weight: Column | float) -> Column:
    return x * weight


def mood_label(score: Column, p: MoodParams = MoodParams()) -> Column:
    return (
        F.when(score <= p.very_low, "extreme_bearish")
        .when(score <= p.low, "bearish")
        .when(score >= p.very_high, "extreme_bullish")
        .when(score >= p.high, "bullish")
        .otherwise("neutral")
    )


def mood_flags(smooth: Column, roc: Column, p: MoodParams = MoodParams()) -> Column:
    """The seven boolean flags of one sentiment state."""
    return F.struct(
        (roc < -p.roc_limit).alias("rapid_deterioration"),
        (roc > p.roc_limit).alias("rapid_improvement"),
        (smooth <= p.very_low).alias("extreme_bearish"),
        (smooth >= p.very_high).alias("extreme_bullish"),
        ((smooth > p.very_low) & (smooth <= p.low)).alias("bearish"),
        ((smooth >= p.high) & (smooth < p.very_high)).alias("bullish"),
        ((smooth > p.low) & (smooth < p.high)).alias("neutral"),
    )


def tone(score: Column) -> Column:
    """Bullish above 0.3, bearish below -0.3, neutral between (ends included)."""
    return F.when(score > 0.3, "bullish").when(score < -0.3, "bearish").otherwise("neutral")


def social_score(popularity: Column, change_pct: Column) -> Column:
    return (
        F.when(
            popularity > 0.9,
            F.when(change_pct < -2, -0.6).when(change_pct > 2, 0.6).otherwise(0.3),
        )
        .when(popularity < 0.1, 0.0)
        .otherwise(popularity * 0.2)
    )


def social_confidence(popularity: Column) -> Column:
    return F.least(popularity, F.lit(0.8))


def net_ratio(net: Column) -> Column:
    return net / (F.abs(net) + TINY)


def news_score(ratio: Column, holding_change: Column) -> Column:
    """Dragon-tiger net ratio and northbound change (already a fraction)."""
    return clip(0.6 * ratio + 0.4 * holding_change, -1.0, 1.0)


def news_confidence(has_net: Column) -> Column:
    return F.when(has_net, 0.7).otherwise(0.4)


def flow_ratio(main: Column, retail: Column) -> Column:
    return main / (F.abs(main) + F.abs(retail) + TINY)


def margin_drift(balance: Column) -> Column:
    return clip((balance - TYPICAL_BALANCE) / (TYPICAL_BALANCE + TINY), -1.0, 1.0)


def forum_score(ratio: Column, drift: Column) -> Column:
    return clip(0.6 * ratio + 0.4 * drift, -1.0, 1.0)


def volume_ratio(volume: Column) -> Column:
    return clip(volume / (TYPICAL_VOLUME + TINY), 0.1, 10.0)


def search_score(drift: Column, ratio: Column) -> Column:
    return clip(0.6 * drift + 0.4 * (ratio - 1), -1.0, 1.0)


def article_score(raw: Column, assume_unit_interval: bool = True) -> Column:
    """Article sentiment on [-1, 1]; values already in [0, 1] are stretched."""
    if not assume_unit_interval:
        return clip(raw, -1.0, 1.0)
    return F.when((raw >= 0) & (raw <= 1), raw * 2 - 1).otherwise(clip(raw, -1.0, 1.0))


def post_score(raw: Column) -> Column:
    return clip(raw, -1.0, 1.0)


def interest_score(ratio: Column, change: Column) -> Column:
    """Search volume against its baseline, read with the day's price change."""
    return F.when(
        ratio > 1.5, F.when(change < -0.02, -0.7).when(change > 0.02, 0.7).otherwise(0.3)
    ).otherwise(0.0)


def extreme_value(rows_seen: Column, smooth: Column, z: Column, p: MoodParams = MoodParams()) -> Column:
    """The number the extreme test looks at: |ema| while warming up, |z| afterwards."""
    return F.when(rows_seen < p.warmup_rows, F.abs(smooth)).otherwise(F.abs(or_zero(z)))


def extreme_flag(rows_seen: Column, value: Column, p: MoodParams = MoodParams()) -> Column:
    return F.when(rows_seen < p.warmup_rows, value >= p.warmup_limit).otherwise(value >= p.extreme_std)
