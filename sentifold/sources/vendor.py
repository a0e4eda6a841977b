"""Landed vendor tables: declared schemas on the way in, one set of column names afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basic import first_existing, parse_number, usable_symbol
from ..params import (
    CODE_HEADERS,
    DRAGON_TIGER_HEADERS,
    MAIN_FLOW_HEADERS,
    MARGIN_BALANCE_HEADERS,
    MARGIN_CODE_HEADERS,
    NORTHBOUND_HEADERS,
    RETAIL_FLOW_HEADERS,
    SPOT_CHANGE_HEADERS,
    SPOT_VOLUME_HEADERS,
)

def missing() -> Column:
    return F.lit(None).cast("string")


def read_landed(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Landed files of one vendor table, with their feed order as ``seq``.  Text formats need the schema, so nothing
    is inferred."""
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a declared schema")
    reader = spark.read.format(fmt).options(**options)
    rows = (reader.schema(schema) if schema else reader).load(path)
    # Feed order: the file, then the place in it (row numbers grow within a block of a file).
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("seq", place) if "seq" not in rows.columns else rows


def _keyed(df: DataFrame, code: Column, **values: Column) -> DataFrame:
    """One row per usable code.  Where a code repeats, one whole row counts: the last of the feed (``seq``), or
    without a feed order the greatest, so that a rerun gives the same."""
    fed = "seq" in df.columns
    shaped = df.select(
        code.cast("string").alias("symbol"), *(["seq"] if fed else []), *(c.alias(n) for n, c in values.items())
    ).filter(usable_symbol(F.col("symbol")))
    row = F.struct(*values)
    picked = shaped.groupBy("symbol").agg((F.max_by(row, "seq") if fed else F.max(row)).alias("_row"))
    return picked.select("symbol", *(F.col(f"_row.{n}").alias(n) for n in values))


def spot_table(df: DataFrame) -> DataFrame:
    """symbol, change_pct, volume"""
    return _keyed(
        df,
        first_existing(df, ("code", *CODE_HEADERS[:1]), missing()),
        change_pct=parse_number(first_existing(df, ("change_pct", *SPOT_CHANGE_HEADERS), F.lit(0.0)), ""),
        volume=parse_number(first_existing(df, ("volume", *SPOT_VOLUME_HEADERS), F.lit(0.0))),
    )


def dragon_tiger_table(df: DataFrame) -> DataFrame:
    """symbol, net_buy"""
    return _keyed(
        df,
        first_existing(df, ("code", *CODE_HEADERS), missing()),
        net_buy=parse_number(first_existing(df, ("net_buy", *DRAGON_TIGER_HEADERS), F.lit(0.0))),
    )


def northbound_table(df: DataFrame) -> DataFrame:
    """symbol, holding_change as a fraction"""
    change = first_existing(df, ("change_pct", *NORTHBOUND_HEADERS), F.lit(0.0))
    return _keyed(
        df, first_existing(df, ("code", *CODE_HEADERS), missing()), holding_change=parse_number(change, "%") / 100
    )


def fund_flow_table(df: DataFrame) -> DataFrame:
    """symbol, main_net, retail_net"""
    return _keyed(
        df,
        first_existing(df, ("code", *CODE_HEADERS), missing()),
        main_net=parse_number(first_existing(df, ("main_net", *MAIN_FLOW_HEADERS), F.lit(0.0))),
        retail_net=parse_number(first_existing(df, ("retail_net", *RETAIL_FLOW_HEADERS), F.lit(0.0))),
    )


def margin_table(*exchanges: DataFrame) -> DataFrame:
    """symbol, balance over the union of exchange tables, whose code columns differ in name.

    The union has every header of every exchange; per row the first header present counts.
    """
    both = exchanges[0]
    for other in exchanges[1:]:
        both = both.unionByName(other, allowMissingColumns=True)
    headers = [h for h in ("code", *MARGIN_CODE_HEADERS) if h in both.columns]
    balance = first_existing(both, ("balance", *MARGIN_BALANCE_HEADERS), missing())
    if not headers or not {"balance", *MARGIN_BALANCE_HEADERS} & set(both.columns):
        return both.sparkSession.createDataFrame([], "symbol string, balance double")
    code = F.coalesce(*(F.col(f"`{h}`").cast("string") for h in headers))
    return _keyed(both, code, balance=parse_number(balance))


def name_table(df: DataFrame) -> DataFrame:
    """symbol, name from a code/name list; incomplete rows are left out."""
    return df.select(F.col("code").cast("string").alias("symbol"), "name").dropna(subset=["symbol", "name"])
