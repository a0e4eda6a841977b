"""Valuation of many companies against their sector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import value as v
from ..functions.basic import or_zero
from ..operators.latest import earliest
from ..operators.median import exact_medians
from ..operators.series import with_trend
from ..params import ValueParams

PEER_COLUMNS = ("pe_ratio", "pb_ratio", "dividend_yield", "peg_ratio")


def sector_medians(fundamentals: DataFrame, columns: Sequence[str] = PEER_COLUMNS) -> DataFrame:
    return exact_medians(fundamentals, "sector", columns)


def _peers(medians: DataFrame) -> DataFrame:
    """One row per sector (the first, by its values, where a sector is listed twice)."""
    one = earliest(medians.select("sector", *PEER_COLUMNS), ["sector"], list(PEER_COLUMNS))
    return one.select("sector", *(F.col(c).alias(f"peer_{c}") for c in PEER_COLUMNS))


def relative_metrics(df: DataFrame) -> DataFrame:
    """Add relative_pe, relative_pb, dividend_diff, relative_peg from own and peer columns."""
    return df.withColumns(
        {
            "relative_pe": v.ratio_gap(F.col("pe_ratio"), F.col("peer_pe_ratio")),
            "relative_pb": v.ratio_gap(F.col("pb_ratio"), F.col("peer_pb_ratio")),
            "dividend_diff": v.dividend_gap(or_zero(F.col("dividend_yield")), F.col("peer_dividend_yield")),
            "relative_peg": v.ratio_gap(F.col("peg_ratio"), F.col("peer_peg_ratio")),
        }
    )


def value_companies(
    fundamentals: DataFrame, medians: DataFrame, p: ValueParams = ValueParams()
) -> tuple[DataFrame, DataFrame]:
    """Valuation rows, and the companies whose sector has no medians.

    Sectors are few: adaptive execution sees the size of their table and broadcasts it, so companies stay
    where they are; a list too long for that joins by shuffle, with the adaptive skew join.
    """
    peers = _peers(medians)
    rel = [F.col(c) for c in ("relative_pe", "relative_pb", "dividend_diff", "relative_peg")]
    parts = v.value_parts(*rel, p)
    scored = (
        relative_metrics(fundamentals.join(peers, "sector"))
        .withColumn("v", v.value_score(*rel, p))
        .withColumn("label", v.value_label(F.col("v"), p))
        .withColumn("parts", F.create_map(*(x for k, c in parts.items() for x in (F.lit(k), c))))
        .select(
            "symbol", "sector", "v", "label", "relative_pe", "relative_pb", "dividend_diff", "relative_peg", "parts"
        )
    )
    rejected = fundamentals.join(peers, "sector", "left_anti").select("symbol", "sector")
    return scored, rejected


def market_valuation(fundamentals: DataFrame, p: ValueParams = ValueParams()) -> DataFrame:
    """V of each fundamentals row against the market-wide defaults."""
    score = v.market_value_score(
        *(F.col(c) for c in ("pe_ratio", "pe_ttm", "pb_ratio", "dividend_yield", "peg_ratio")), p
    )
    return fundamentals.withColumn("v", score).withColumn("v_label", v.value_label(F.col("v"), p))


def valuation_history(fundamentals: DataFrame, p: ValueParams = ValueParams()) -> DataFrame:
    """V of every snapshot with its trend.  Snapshots are reports, a few per company and year."""
    return with_trend(market_valuation(fundamentals, p), ["symbol"], ["ts"], "v")


def intrinsic_values(
    fundamentals: DataFrame, medians: DataFrame, rate: float = 0.03, p: ValueParams = ValueParams()
) -> DataFrame:
    """Fair value by earnings, book and dividend growth, their mean, and the discount to it."""
    c = {n: or_zero(F.col(n)) for n in ("eps", "book_value_per_share", "dividend_yield")}
    annual = c["dividend_yield"] * c["book_value_per_share"]
    if "annual_dividend" in fundamentals.columns:
        annual = or_zero(F.col("annual_dividend"))
    df = fundamentals.join(_peers(medians), "sector").withColumns(
        {
            "intrinsic_pe": v.fair_by_multiple(c["eps"], F.col("peer_pe_ratio")),
            "intrinsic_pb": v.fair_by_multiple(c["book_value_per_share"], F.col("peer_pb_ratio")),
            "intrinsic_gordon": v.gordon_value(annual, c["dividend_yield"], rate, p),
            "price": v.implied_price(F.col("pe_ratio"), c["eps"], F.col("pb_ratio"), c["book_value_per_share"]),
        }
    )
    fair = v.mean_of_present(F.col("intrinsic_pe"), F.col("intrinsic_pb"), F.col("intrinsic_gordon"))
    return df.withColumn("intrinsic_value", fair).select(
        "symbol",
        "intrinsic_pe",
        "intrinsic_pb",
        "intrinsic_gordon",
        "intrinsic_value",
        F.when(F.col("price") > 0, F.col("intrinsic_value") / F.col("price") - 1).alias("discount_to_intrinsic"),
    )
