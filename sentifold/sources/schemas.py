"""Table schemas.  Money is double; times carry no zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, amount double"

FUNDAMENTALS = (
    "symbol string, ts timestamp_ntz, pe_ratio double, pe_ttm double, pb_ratio double, ps_ratio double, "
    "peg_ratio double, dividend_yield double, roe double, roa double, eps double, "
    "book_value_per_share double, total_mv double, circ_mv double, sector string, industry string"
)

SENTIMENT_RAW = (
    "symbol string, ts timestamp_ntz, source string, score double, confidence double, "
    "raw_data struct<raw_score: double, sample_size: bigint, metadata: map<string, string>>"
)

SENTIMENT_COMPOSITE = (
    "symbol string, ts timestamp_ntz, score double, confidence double, source_scores map<string, double>"
)

NAMES = "symbol string, name string, updated_at timestamp_ntz"

SIGNALS = (
    "symbol string, signal_type string, ts timestamp_ntz, source string, strength double, confidence double, "
    "entry_price double, stop_loss double, take_profit double, position_size double, quantity bigint, "
    "sentiment_score double, valuation_score double, price_z_score double, dislocation double, "
    "reasons array<string>, metadata map<string, string>"
)

TRADES = (
    "trade_id string, order_id string, symbol string, side string, quantity double, price double, "
    "ts timestamp_ntz, commission double, slippage double, source_signal string"
)

POSITIONS = (
    "symbol string, entry_type string, entry_price double, entry_date timestamp_ntz, quantity double, "
    "stop_loss double, take_profit double, original_signal_strength double"
)

ORDER_REQUESTS = (
    "symbol string, side string, order_type string, quantity bigint, price double, stop_price double"
)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Project onto a schema; columns the table lacks become typed NULLs."""
    have = set(df.columns)
    return df.select(
        *(
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(schema)
        )
    )
