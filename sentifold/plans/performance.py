"""Positions, trade costs, the equity curve and the performance report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trading as t
from ..functions.basic import id_text, or_zero
from ..operators.ledger import average_cost_book, fifo_pairs
from ..operators.series import with_drawdown, with_stop
from ..operators.touch import first_hit
from ..params import ContrarianParams, CostParams

# --- positions --------------------------------------------------------------


def position_book(
    fills: DataFrame, order: Sequence[str], prices: DataFrame | None = None
) -> DataFrame:
    """Position and profit per symbol from signed fills (symbol, qty, price).

    Marked at the given prices; a symbol without one keeps its last fill price.  ``realised_open``
    forgets what was earned before a position last went flat, ``realised_all`` does not.
    """
    book = average_cost_book(fills, ["symbol"], order)
    if prices is not None:
        book = book.join(prices.select("symbol", "price"), "symbol", "left")
        price = F.coalesce("price", "last_price")
    else:
        price = F.col("last_price")
    q, cost = F.col("quantity"), F.col("avg_cost")
    return book.withColumn("current_price", price).select(
        "symbol",
        "quantity",
        "avg_cost",
        "current_price",
        t.market_value(q, F.col("current_price")).alias("market_value"),
        or_zero((F.col("current_price") - cost) * q).alias("unrealised"),
        "realised_open",
        "realised_all",
        F.when(q != 0, t.return_pct(q > 0, cost, F.col("current_price"))).alias("return_pct"),
        "n_fills",
    )


def book_totals(book: DataFrame) -> DataFrame:
    return book.agg(
        F.count_if(F.col("quantity") != 0).alias("num_positions"),
        or_zero(F.sum("market_value")).alias("total_market_value"),
        or_zero(F.sum("unrealised")).alias("total_unrealised"),
        or_zero(F.sum("realised_open")).alias("total_realised_open"),
        or_zero(F.sum("realised_all")).alias("total_realised_all"),
        F.sum(F.abs("quantity")).alias("total_quantity"),
    )


def account_balance(book: DataFrame, cash: float) -> DataFrame:
    """Equity, buying power and margin at a cash balance (fixed values: twice cash, half the value)."""
    value = or_zero(F.sum("market_value"))
    return book.agg(
        (F.lit(float(cash)) + value).alias("total_equity"),
        F.lit(float(cash)).alias("cash"),
        F.lit(2.0 * cash).alias("buying_power"),
        (value * 0.5).alias("margin_used"),
        F.lit(float(cash)).alias("available_withdrawal"),
        value.alias("market_value"),
    )


# --- trades -----------------------------------------------------------------


def cost_trades(trades: DataFrame, p: CostParams = CostParams(), model: str = "next_open") -> DataFrame:
    """Fill price, costs and identifiers of each trade: one narrow pass, no shuffle."""
    side, q, price = F.col("side"), F.col("quantity"), F.col("price")
    return (
        trades.withColumn("fill_price", t.fill_price(side, price, model, p))
        .withColumn("notional", t.notional(q, F.col("fill_price")))
        .withColumn("commission", t.commission(F.col("notional"), p))
        .withColumn("stamp_duty", t.stamp_duty(side, F.col("notional"), p))
        .withColumn("slippage", F.abs(F.col("fill_price") - price) * q)
        .withColumn("total_cost", F.col("notional") + F.col("commission") + F.col("stamp_duty"))
        .withColumn("trade_id", id_text(F.col("symbol"), F.col("ts")))
    )


def trade_breakdown(trades: DataFrame) -> DataFrame:
    return trades.agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(F.col("side") == "BUY").alias("buys"),
        F.count_if(F.col("side") == "SELL").alias("sells"),
        or_zero(F.sum("commission")).alias("commission_total"),
    )


def round_trips(trades: DataFrame, order: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Closed pairs with profit net of both commissions; the SELL quantity counts for both legs."""
    pairs = fifo_pairs(trades, list(keys), order, ["price", "quantity", "commission"])
    q = F.col("sell_quantity")
    pnl = (F.col("sell_price") - F.col("buy_price")) * q - (F.col("sell_commission") + F.col("buy_commission"))
    return pairs.withColumn("pnl", pnl).withColumn("trade_return", F.col("pnl") / (F.col("buy_price") * q))


def trade_statistics(pairs: DataFrame) -> DataFrame:
    """Win rate and profit factor in one row.  Without losses the factor is NULL and flagged."""
    won = F.col("pnl") > 0
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(won).alias("wins"),
        or_zero(F.sum(F.when(won, F.col("pnl")))).alias("gross_profit"),
        or_zero(F.sum(F.when(~won, -F.col("pnl")))).alias("gross_loss"),
        F.avg(F.when(won, F.col("pnl"))).alias("mean_win"),
        F.avg(F.when(~won, -F.col("pnl"))).alias("mean_loss"),
    ).select(
        "*",
        F.when(F.col("n_pairs") > 0, F.col("wins") / F.col("n_pairs")).otherwise(0.0).alias("win_rate"),
        F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss"))
        .when(F.col("gross_profit") > 0, F.lit(None))
        .otherwise(0.0)
        .alias("profit_factor"),
        ((F.col("gross_loss") == 0) & (F.col("gross_profit") > 0)).alias("no_losses"),
    )


# --- equity curve -----------------------------------------------------------


def mark_to_market(
    trades: DataFrame, bars: DataFrame, initial: float, order: Sequence[str] = ("ts",), bar_order: str = "day"
) -> DataFrame:
    """Daily equity from costed trades (symbol, day, side, quantity, fill_price, costs) and closes.

    Of several bars or fills on a day the last by ``bar_order`` or ``order`` counts.  A symbol is marked at its
    last close; only before its first bar does the last fill price stand in.
    Both tables shrink to one row per symbol and day.  A symbol's value changes only on days with
    a bar or a fill, so summing those changes per day and accumulating over days gives the holding
    value without a symbol-by-day grid.  The last window runs over one row per calendar day.
    """
    buy = F.col("side") == "BUY"
    signed = F.when(buy, F.col("quantity")).otherwise(-F.col("quantity"))
    flow = -signed * F.col("fill_price") - F.col("commission") - F.col("stamp_duty")
    moves = trades.groupBy("symbol", "day").agg(
        F.sum(signed).alias("dq"),
        F.sum(flow).alias("flow"),
        F.max_by("fill_price", F.struct(*order)).alias("fill"),
    )
    closes = bars.groupBy("symbol", "day").agg(F.max_by("close", bar_order).alias("close"))
    both = moves.join(closes, ["symbol", "day"], "full")
    w = Window.partitionBy("symbol").orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    valued = both.withColumn("held", F.sum(F.coalesce("dq", F.lit(0.0))).over(upto)).withColumn(
        "mark",
        F.coalesce(F.last("close", ignorenulls=True).over(upto), F.last("fill", ignorenulls=True).over(upto)),
    )
    valued = valued.withColumn("value", F.col("held") * F.col("mark"))
    daily = (
        valued.withColumn("dv", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)))
        .groupBy("day")
        .agg(F.sum("dv").alias("dv"), or_zero(F.sum("flow")).alias("flow"))
    )
    days = Window.partitionBy("curve").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (
        daily.withColumn("curve", F.lit(0))
        .withColumn("cash", initial + F.sum("flow").over(days))
        .withColumn("positions_value", F.sum("dv").over(days))
        .select(
            F.col("day").alias("date"),
            (F.col("cash") + F.col("positions_value")).alias("equity"),
            "cash",
            "positions_value",
        )
    )


def curve_measures(curve: DataFrame, p: CostParams = CostParams(), stop: bool = True) -> DataFrame:
    """Return, annual return, drawdown and Sharpe ratio of a daily curve (date, equity), one row.

    The curve has a row per day, so one task holds it easily.  With ``stop`` it counts up to the
    first drawdown past the limit; the annual return is still over the whole span of days.
    """
    one = curve.select("date", "equity").withColumn("curve", F.lit(0))
    one = with_drawdown(one, ["curve"], ["date"], "equity", p.initial_capital)
    one = with_stop(one, ["curve"], ["date"], p.drawdown_stop if stop and p.drawdown_stop else float("inf"))
    before = F.lag("equity").over(Window.partitionBy("curve").orderBy("date"))
    one = one.withColumn("daily", (F.col("equity") - before) / before)
    counted = lambda c: F.when(~F.col("stopped"), c)
    m = one.agg(
        F.max_by("equity", counted(F.col("date"))).alias("final_capital"),
        F.max(counted(F.col("drawdown"))).alias("max_drawdown"),
        F.avg(counted(F.col("daily"))).alias("_mean"),
        F.stddev_pop(counted(F.col("daily"))).alias("_std"),
        F.datediff(F.max("date"), F.min("date")).alias("_days"),
        F.count_if(~F.col("stopped")).alias("n_days"),
    )
    years = F.greatest(F.col("_days") / 365.0, F.lit(1 / 252))
    gain = F.col("total_return")
    return (
        m.withColumn("initial_capital", F.lit(p.initial_capital))
        .withColumn("total_return", (F.col("final_capital") - p.initial_capital) / p.initial_capital)
        .withColumn("annualized_return", F.when(gain > -1, F.pow(1 + gain, 1 / years) - 1))
        .withColumn(
            "sharpe_ratio",
            F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * F.sqrt(F.lit(float(p.trading_days)))).otherwise(
                F.lit(0.0)
            ),
        )
        .drop("_mean", "_std", "_days")
    )


def performance_report(
    curve: DataFrame, trades: DataFrame, order: Sequence[str], p: CostParams = CostParams(), stop: bool = True
) -> DataFrame:
    """The published one-row report from an equity curve and a trade table."""
    stats = trade_statistics(round_trips(trades, order)).select(F.struct("win_rate", "profit_factor", "no_losses"))
    total = trades.agg(F.count(F.lit(1))).scalar()
    return curve_measures(curve, p, stop).withColumn("_s", stats.scalar()).select(
        "initial_capital",
        "final_capital",
        "total_return",
        "annualized_return",
        "sharpe_ratio",
        "max_drawdown",
        "_s.win_rate",
        total.alias("total_trades"),
        "_s.profit_factor",
        "_s.no_losses",
    )


# --- exits ------------------------------------------------------------------


def first_touch(
    entries: DataFrame, bars: DataFrame, p: ContrarianParams = ContrarianParams(), limit: int | None = None
) -> DataFrame:
    """For each entry the first later bar that calls for an exit; without one it stays open.

    ``entries``: symbol, day, signal_type, entry_price, stop_loss, take_profit, on any day.
    ``bars``: one row per symbol and day with close and optionally mood, v.
    """
    number = F.lit(None).cast("double")
    extra = [c if c in bars.columns else number.alias(c) for c in ("mood", "v")]
    bars = bars.select("symbol", "day", "close", *extra)
    # A reversal needs both values, so a bar that lacks one takes part with its close only.
    known = F.col("mood").isNotNull() & F.col("v").isNotNull()
    bars = bars.withColumns({c: F.when(known, F.col(c)) for c in ("mood", "v")})

    def calls(low, high):
        long = F.col("signal_type") == "BUY"
        no = F.lit(False)
        falls = (low("close") <= F.col("stop_loss")) | (high("close") >= F.col("take_profit"))
        rises = (high("close") >= F.col("stop_loss")) | (low("close") <= F.col("take_profit"))
        turned = F.when(long, high("mood") > p.mood_reversal).otherwise(low("mood") < -p.mood_reversal)
        valued = F.when(long, low("v") < p.value_reversal).otherwise(high("v") > p.value_reversal)
        return F.coalesce(F.when(long, falls).otherwise(rises), no) | F.coalesce(turned, no) | F.coalesce(valued, no)

    tie = ["signal_type", "entry_price", "stop_loss", "take_profit"]
    touched = first_hit(entries, bars, "symbol", "day", ["close", "mood", "v"], calls, tie, limit)
    hit = F.col("found")
    why = t.exit_reason(
        F.col("signal_type"), hit["close"], F.col("stop_loss"), F.col("take_profit"), hit["mood"], hit["v"], p
    )
    gain = t.return_pct(F.col("signal_type") == "BUY", F.col("entry_price"), hit["close"])
    return touched.select(
        "symbol",
        "day",
        "signal_type",
        "entry_price",
        hit["day"].alias("exit_day"),
        F.when(hit.isNotNull(), why).otherwise("open").alias("exit_reason"),
        gain.alias("exit_return"),
    )
