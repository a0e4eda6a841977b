"""Small helpers shared by every formula."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The exchange markers that may precede a six-digit code.
EXCHANGE_MARKERS = ("SH", "SZ", "BJ")


def clip(x: Column, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def nonzero(x: Column) -> Column:
    """NULL for zero, so that ``coalesce`` moves on at zero as well as at NULL."""
    return F.nullif(x, F.lit(0.0))


def strip_exchange(code: Column) -> Column:
    """Drop a leading SH/SZ/BJ from a code longer than two characters."""
    marked = (F.length(code) > 2) & F.substring(code, 1, 2).isin(*EXCHANGE_MARKERS)
    return F.when(marked, F.substr(code, F.lit(3))).otherwise(code)


def parse_number(text: Column, drop: str = ",") -> Column:
    """Number from text such as ``1,234.5`` or ``0.8%``; unreadable or missing gives 0."""
    return or_zero(F.replace(text.cast("string"), F.lit(drop), F.lit("")).try_cast("double"))


def usable_symbol(symbol: Column) -> Column:
    return symbol.isNotNull() & ~symbol.isin("", "nan")


def first_existing(df: DataFrame, names: Sequence[str], default: Column) -> Column:
    """Column of the first header the table has, or the default when it has none."""
    for name in names:
        if name in df.columns:
            return F.col(f"`{name}`")
    return default


def id_text(symbol: Column, ts: Column, suffix: str = "") -> Column:
    """``symbol_yyyyMMdd_HHmmss`` with an optional suffix, the trade identifier."""
    return F.concat(symbol, F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(suffix))


def order_id_text(symbol: Column, ts: Column) -> Column:
    return F.concat(F.lit("ORD_"), symbol, F.lit("_"), F.date_format(ts, "yyyyMMddHHmmss"))


def parse_iso(text: Column, as_of: Column) -> Column:
    """ISO timestamp, or the run time where the field is absent or unreadable."""
    return F.coalesce(text.try_cast("timestamp_ntz"), as_of)
