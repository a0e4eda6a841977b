"""Ranked verdicts: the most bearish or most bullish symbols with their valuation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import value as v
from ..operators.latest import top_rows
from ..operators.sizes import BROADCAST_ROWS
from ..params import ValueParams
from .valuation import market_valuation


def latest_by_semi_join(composite: DataFrame, ts: str = "day") -> DataFrame:
    """Rows of each symbol's latest time.  The maximum is aggregated before it moves."""
    newest = composite.groupBy("symbol").agg(F.max(ts).alias(ts))
    return composite.join(newest, ["symbol", ts], "left_semi")


def extreme_symbols(composite: DataFrame, n: int, bottom: bool = True, ts: str = "day") -> DataFrame:
    """The n lowest or highest latest scores; equal scores by symbol."""
    newest = composite.groupBy("symbol").agg(F.max_by("score", ts).alias("sentiment_score"))
    score = F.asc("sentiment_score") if bottom else F.desc("sentiment_score")
    return top_rows(newest, n, score, "symbol")


def verdicts(
    composite: DataFrame,
    fundamentals: DataFrame,
    names: DataFrame,
    n: int = 10,
    bottom: bool = True,
    mood_weight: float = 0.5,
    mood_scale: float = 1.0,
    ts: str = "day",
    p: ValueParams = ValueParams(),
) -> DataFrame:
    """Verdict rows of the n extreme symbols, best candidate first.

    The list is cut to n before it meets the dimensions.  The n rows are broadcast only while n is
    small; a longer list joins by shuffle.
    """
    picked = extreme_symbols(composite, n, bottom, ts).withColumn(
        "sentiment_score", F.col("sentiment_score") * mood_scale
    )
    facts = fundamentals.join(F.broadcast(picked) if n <= BROADCAST_ROWS else picked, "symbol")
    m = F.col("sentiment_score")
    df = (
        market_valuation(facts, p)
        .join(names.select("symbol", "name"), "symbol", "left")
        .withColumn("name", F.coalesce("name", "symbol"))
        .withColumn("valuation_score", F.col("v"))
        .withColumn("combined_score", v.combined_score(m, F.col("v"), bottom, mood_weight))
        .withColumn("verdict", v.verdict(m, F.col("v"), bottom))
        .withColumn("confidence", v.verdict_confidence(m, F.col("v"), bottom))
    )
    best = F.desc("combined_score") if bottom else F.asc("combined_score")
    return df.select(
        "symbol", "name", "sentiment_score", "valuation_score", "combined_score", "verdict",
        "pe_ratio", "pb_ratio", "dividend_yield", "peg_ratio", "confidence",
    ).orderBy(best, "symbol")
