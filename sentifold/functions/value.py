"""Valuation formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import ValueParams
from .basic import clip, nonzero, or_zero


def ratio_gap(own: Column, peer: Column) -> Column:
    """own/peer - 1 when both are positive, else the neutral 0."""
    return F.when((own > 0) & (peer > 0), own / peer - 1).otherwise(F.lit(0.0))


def dividend_gap(own: Column, peer: Column) -> Column:
    return F.when(peer > 0, own / peer - 1).when(own > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def value_parts(pe: Column, pb: Column, dividend: Column, peg: Column, p: ValueParams = ValueParams()) -> dict:
    """The four signed contributions to V, keyed as they are published."""
    return {
        "PE": -pe * p.pe_weight,
        "PB": -pb * p.pb_weight,
        "dividend": dividend * p.dividend_weight,
        "PEG": -peg * p.peg_weight,
    }


def value_score(pe: Column, pb: Column, dividend: Column, peg: Column, p: ValueParams = ValueParams()) -> Column:
    parts = value_parts(pe, pb, dividend, peg, p)
    return parts["PE"] + parts["PB"] + parts["dividend"] + parts["PEG"]


def value_label(v: Column, p: ValueParams = ValueParams()) -> Column:
    return (
        F.when(v >= p.deep_under, "deeply_undervalued")
        .when(v >= p.under, "undervalued")
        .when(v >= p.over, "fair_value")
        .when(v >= p.deep_over, "overvalued")
        .otherwise("deeply_overvalued")
    )


def own_pe(pe: Column, pe_ttm: Column) -> Column:
    """P/E, or the trailing one where it is missing or zero, or 0."""
    return F.coalesce(nonzero(pe), nonzero(pe_ttm), F.lit(0.0))


def market_value_score(
    pe: Column, pe_ttm: Column, pb: Column, dividend: Column, peg: Column, p: ValueParams = ValueParams()
) -> Column:
    """V of a fundamentals row against the market-wide defaults."""
    return value_score(
        ratio_gap(own_pe(pe, pe_ttm), F.lit(p.market_pe)),
        ratio_gap(or_zero(pb), F.lit(p.market_pb)),
        dividend_gap(or_zero(dividend), F.lit(p.market_dividend)),
        ratio_gap(peg, F.lit(p.market_peg)),
        p,
    )


def fair_by_multiple(per_share: Column, peer_multiple: Column) -> Column:
    """Per-share figure times the peer multiple, NULL unless both are positive."""
    return F.when((per_share > 0) & (peer_multiple > 0), per_share * peer_multiple)


def gordon_value(annual_dividend: Column, dividend_yield: Column, rate: float, p: ValueParams = ValueParams()) -> Column:
    if rate <= p.growth:
        return F.lit(None).cast("double")
    return F.when(dividend_yield > 0, annual_dividend * (1 + p.growth) / (rate - p.growth))


def mean_of_present(*values: Column) -> Column:
    total = sum((or_zero(v) for v in values), F.lit(0.0))
    count = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.when(count > 0, total / count)


def implied_price(pe: Column, eps: Column, pb: Column, book: Column) -> Column:
    return F.when((pe > 0) & (eps > 0), pe * eps).when((pb > 0) & (book > 0), pb * book)


def value_points(pe: Column, pb: Column, roe: Column) -> Column:
    """Points scheme: cheap multiples and a good return on equity add, dear ones subtract."""
    pe, pb, roe = nonzero(pe), nonzero(pb), nonzero(roe)
    return (
        F.when(pe < 15, 0.2).when(pe > 30, -0.2).otherwise(0.0)
        + F.when(pb < 1.5, 0.15).when(pb > 4, -0.15).otherwise(0.0)
        + F.when(roe > 0.15, 0.1).otherwise(0.0)
    )


def combined_score(mood: Column, v: Column, bottom: bool = True, mood_weight: float = 0.5) -> Column:
    """Sentiment and valuation on one 0-100 scale; the valuation side flips for a top list."""
    mood100 = clip((mood + 5) / 10 * 100, 0.0, 100.0)
    value100 = clip((v + 0.5) * 100, 0.0, 100.0)
    side = value100 if bottom else 100 - value100
    return mood100 * mood_weight + side * (1.0 - mood_weight)


def verdict(mood: Column, v: Column, bottom: bool = True) -> Column:
    # The sign rule contains the threshold rule (|mood| > 1.5 and |V| > 0.10).
    if bottom:
        return F.when((mood < 0) & (v > 0), "BUY").otherwise("HOLD")
    return F.when((mood > 0) & (v < 0), "SELL").otherwise("HOLD")


def verdict_confidence(mood: Column, v: Column, bottom: bool = True) -> Column:
    agree = (mood < 0) & (v > 0) if bottom else (mood > 0) & (v < 0)
    return F.when(agree, F.least(F.lit(0.9), 0.5 + F.abs(mood) * 0.1 + F.abs(v))).otherwise(F.lit(0.5))


def verdict_strength(score: Column) -> Column:
    size = F.abs(score)
    return F.when(size >= 0.7, "STRONG").when(size >= 0.4, "MODERATE").otherwise("WEAK")
