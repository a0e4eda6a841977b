"""Orders: from portfolio to order list, the risk screen, stop-loss and daily-loss checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trading as t
from ..functions.basic import nonzero, or_zero, order_id_text
from ..params import RiskParams


def order_list(portfolio: DataFrame, dry_run: bool = True) -> DataFrame:
    """Entry signals as order rows; a missing or zero quantity becomes 100."""
    entries = portfolio.filter(t.is_entry(F.col("signal_type")))
    return entries.select(
        order_id_text(F.col("symbol"), F.col("ts")).alias("order_id"),
        "symbol",
        F.when(F.col("signal_type") == "BUY", "BUY").otherwise("SELL").alias("side"),
        F.coalesce(F.nullif(F.col("quantity"), F.lit(0)), F.lit(100)).cast("bigint").alias("quantity"),
        F.lit("MARKET").alias("order_type"),
        F.lit("dry_run" if dry_run else "pending").alias("status"),
        F.col("source").alias("source_signal"),
    )


def requests_of(requests: DataFrame, symbol: str | None = None) -> DataFrame:
    """Order requests, of one symbol if given."""
    return requests if symbol is None else requests.filter(F.col("symbol") == symbol)


def exposure(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Number of open positions and their value at market, as one row; unpriced ones count as 0."""
    priced = positions.join(prices.select("symbol", "price"), "symbol", "left")
    return priced.agg(
        F.count_if(F.col("quantity") != 0).alias("n_open"),
        or_zero(F.sum(F.abs("quantity") * or_zero(F.col("price")))).alias("value"),
    )


def screen_orders(
    requests: DataFrame,
    positions: DataFrame,
    prices: DataFrame,
    account_balance: Column | float | None = None,
    daily_loss: Column | float | None = None,
    custom_limits: DataFrame | None = None,
    p: RiskParams = RiskParams(),
) -> DataFrame:
    """Add ``fault`` (NULL when accepted) and ``fault_kind``; the first failing check is reported.

    Each request is judged against the one snapshot.  Portfolio totals are a one-row aggregate read
    as scalars.  What is known of a symbol is put into one row first, so the requests are joined once
    and nothing after that join needs their partitioning: Spark's adaptive skew join can split a
    symbol with very many requests.
    """
    totals = exposure(positions, prices)
    n_open, held_value = totals.select("n_open").scalar(), totals.select("value").scalar()
    known = positions.select("symbol", F.col("quantity").alias("_held")).join(
        prices.select("symbol", F.col("price").alias("_market")), "symbol", "full"
    )
    limit = F.lit(p.max_position)
    if custom_limits is not None:
        known = known.join(custom_limits.select("symbol", F.col("position_limit").alias("_limit")), "symbol", "full")
        limit = F.coalesce(F.col("_limit"), limit)
    df = requests.join(known, "symbol", "left")
    buy, qty = F.lower("side") == "buy", F.col("quantity")
    held = F.coalesce(F.col("_held"), F.lit(0))
    new = F.when(buy, held + qty).otherwise(held - qty)
    price = F.coalesce(nonzero(F.col("price")), F.col("_market"))
    value = price * qty
    balance = F.lit(None) if account_balance is None else account_balance
    loss = F.lit(None) if daily_loss is None else daily_loss
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    basic = t.request_fault(
        F.col("symbol"), qty, F.lower("order_type"), F.col("price"), F.col("stop_price")
    )
    fault = F.coalesce(
        basic,
        F.when(F.abs(new) > limit, "position_limit")
        .when((held == 0) & (new != 0) & (n_open >= p.max_positions), "max_positions")
        .when(price.isNull(), "no_market_price")
        .when(value > p.max_order_value, "order_value")
        .when(held_value + value > p.max_total_value, "total_value")
        .when(as_column(loss) >= p.max_daily_loss, "daily_loss")
        .when(buy & (value > as_column(balance)), "insufficient_funds")
        .when(~buy & (qty > F.abs(held)), "insufficient_position"),
    )
    f = F.col("fault")
    kind = (
        F.when(f.isin("invalid_symbol", "invalid_quantity", "insufficient_funds", "insufficient_position"), f)
        .when(
            f.isin(
                "limit_price_missing", "stop_price_missing", "price_not_positive", "stop_price_not_positive",
                "no_market_price",
            ),
            "invalid_price",
        )
        .when(f.isNotNull(), "risk_limit_exceeded")
    )
    out = df.withColumn("fault", fault).withColumn("fault_kind", kind)
    return out.select(*requests.columns, "fault", "fault_kind")


def daily_losses(balances: DataFrame, keys: Sequence[str] = ("account",), ts: str = "ts") -> DataFrame:
    """Day-start balance less the latest one per account and day: two picks in one aggregate."""
    return (
        balances.groupBy(*keys, F.to_date(ts).alias("day"))
        .agg(F.min_by("balance", ts).alias("start_balance"), F.max_by("balance", ts).alias("current_balance"))
        .withColumn("daily_loss", F.col("start_balance") - F.col("current_balance"))
    )


def close_all(losses: DataFrame, p: RiskParams = RiskParams()) -> DataFrame:
    """Accounts and days on which every position is to be closed."""
    return losses.withColumn("limit_reached", F.col("daily_loss") >= p.max_daily_loss)


def risk_summary(losses: DataFrame, custom_limits: DataFrame | None = None, p: RiskParams = RiskParams()) -> DataFrame:
    """Limits beside the current loss of each account."""
    custom = F.lit(0).cast("bigint") if custom_limits is None else custom_limits.agg(F.count(F.lit(1))).scalar()
    return close_all(losses, p).withColumns(
        {
            "max_position_size": F.lit(p.max_position),
            "max_total_position_value": F.lit(p.max_total_value),
            "max_positions": F.lit(p.max_positions),
            "max_daily_loss": F.lit(p.max_daily_loss),
            "stop_loss_percent": F.lit(p.stop_percent),
            "custom_position_limits": custom,
        }
    )


def stop_loss_scan(positions: DataFrame, prices: DataFrame | None = None, p: RiskParams = RiskParams()) -> DataFrame:
    """Positions past the stop; with fresh prices given, unpriced positions keep their old price."""
    if prices is not None:
        positions = (
            positions.join(prices.select("symbol", F.col("price").alias("_new")), "symbol", "left")
            .withColumn("current_price", F.coalesce("_new", "current_price"))
            .drop("_new")
        )
    return positions.filter(
        (F.col("quantity") != 0) & t.stop_loss_hit(F.col("quantity"), F.col("avg_cost"), F.col("current_price"), p)
    )


def order_fills(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Filled quantity, average fill price and status of each order.

    An order without a fill has filled nothing and keeps the status it came with (pending without one).
    """
    done = fills.groupBy("order_id").agg(
        F.sum("quantity").alias("_filled"),
        (F.sum(F.col("quantity") * F.col("price")) / F.sum("quantity")).alias("avg_fill_price"),
    )
    before = F.col("status") if "status" in orders.columns else F.lit("pending")
    filled = F.coalesce(F.col("_filled"), F.lit(0.0))
    met = orders.join(done, "order_id", "left").withColumn("filled_quantity", filled)
    status = (
        F.when(F.col("_filled").isNull(), before)
        .when(F.col("filled_quantity") >= F.col("quantity"), "filled")
        .otherwise("partially_filled")
    )
    return met.withColumn("status", status).withColumn(
        "remaining_quantity", F.col("quantity") - F.col("filled_quantity")
    ).drop("_filled")
