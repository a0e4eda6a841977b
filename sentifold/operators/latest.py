"""One row, or a few rows, per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], choose) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(choose(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest order per key.  An aggregate, so each task first keeps one row per key
    and a large key costs no more shuffle than a small one."""
    return _pick(df, keys, order, F.max_by)


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n newest rows per key.  Spark cuts each task to n rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def top_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of the whole table (``TakeOrderedAndProject``: no full sort)."""
    return df.orderBy(*order).limit(n)
