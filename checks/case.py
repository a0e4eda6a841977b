"""What one registered query consists of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Tables


@dataclass(frozen=True)
class Case:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    sql: str | None = None


# Share of the last digit added before cutting.  One half would round as usual, but values that end
# exactly on half a digit are common here (cents over 16 or 32 shares) and may land on either side;
# with this share no short decimal lies on the border, and values already on the grid stay put.
SHARE = 0.8718281828


def rd(column: Column | str, digits: int = 6) -> Column:
    """Rounded by plain arithmetic, the same in both engines."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c * F.lit(float(10**digits)) + F.lit(SHARE)) / F.lit(float(10**digits))


def rq(text: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"floor(CAST({text} AS DOUBLE) * 1e{digits} + {SHARE}) / 1e{digits}"


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Every double rounded; days and times as text."""
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            out.append(rd(F.col(f"`{name}`"), special.get(name, digits)).alias(name))
        elif kind == "date":
            out.append(F.col(name).cast("string").alias(name))
        elif kind.startswith("timestamp"):
            out.append(F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name))
        elif kind == "int":
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def day(text: str = "day") -> str:
    return f"CAST({text} AS VARCHAR)"


def stamp(text: str = "ts") -> str:
    return f"strftime({text}, '%Y-%m-%d %H:%M:%S.%f')"
