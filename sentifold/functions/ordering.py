"""An order of several columns as one number, so that picking by it stays a hash aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIMES = ("timestamp", "timestamp_ntz", "date")
_NUMBERS = ("bigint", "int", "smallint", "tinyint")
# A time takes 18 digits (microseconds since 1970 and this offset: 1200 years back), an integer 20.
_TIME_OFFSET, _NUMBER_OFFSET, _SHIFT = 10**17, 2**63, 10**20


def micros(column: Column, kind: str) -> Column:
    """Microseconds since 1970; a time without zone counts as it stands, whatever the session's zone."""
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "date":
        return F.unix_date(column).cast("bigint") * 86_400_000_000
    since = column - F.lit("1970-01-01").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(24,6)") * 1_000_000).cast("bigint")


def packed(df: DataFrame, order: Sequence[str]) -> Column:
    """The order as a decimal where it is a time, an integer, or both in this turn; else as a struct.

    Equal orders give equal values, so values picked by it one by one come from the same row.
    """
    kinds = dict(df.dtypes)
    names = [kinds[c] for c in order]
    is_time = [k in _TIMES for k in names]
    if len(order) == 1 and is_time[0]:
        return micros(F.col(order[0]), names[0])
    if len(order) == 1 and names[0] in _NUMBERS:
        return F.col(order[0]).cast("bigint")
    if len(order) == 2 and is_time[0] and names[1] in _NUMBERS:
        high = (micros(F.col(order[0]), names[0]).cast("decimal(18,0)") + F.lit(_TIME_OFFSET).cast("decimal(18,0)")).cast("decimal(18,0)")
        low = F.col(order[1]).cast("decimal(20,0)") + F.lit(str(_NUMBER_OFFSET)).cast("decimal(20,0)")
        return (high * F.lit(str(_SHIFT)).cast("decimal(21,0)") + low).cast("decimal(38,0)")
    return F.struct(*order)
