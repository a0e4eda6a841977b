"""Signal, order, position and cost formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import (
    ACTIVE_STATUSES,
    ENTRY_TYPES,
    EXIT_TYPES,
    FINAL_STATUSES,
    ContrarianParams,
    CostParams,
    RiskParams,
    RouterParams,
)
from .basic import clip


def is_entry(signal_type: Column) -> Column:
    return signal_type.isin(*ENTRY_TYPES)


def is_exit(signal_type: Column) -> Column:
    return signal_type.isin(*EXIT_TYPES)


def strength_level(strength: Column) -> Column:
    return F.when(strength >= 70, "STRONG").when(strength >= 40, "MODERATE").otherwise("WEAK")


def conviction(mood: Column, v: Column, p: ContrarianParams = ContrarianParams()) -> Column:
    """Strength 0-100 of the long case; negate both inputs for the short case."""
    mood_part = F.greatest(-mood, F.lit(0.0)) / p.mood_scale
    value_part = F.least(v, F.lit(p.value_cap)) / p.value_cap
    return clip((mood_part * p.mood_share + value_part * p.value_share) * 100, 0.0, 100.0)


def stop_level(side: Column, price: Column, pct: float) -> Column:
    return F.when(side == "BUY", price * (1 - pct)).when(side == "SELL", price * (1 + pct))


def target_level(side: Column, price: Column, pct: float) -> Column:
    return F.when(side == "BUY", price * (1 + pct)).when(side == "SELL", price * (1 - pct))


def share_count(strength: Column, price: Column, p: ContrarianParams = ContrarianParams()) -> Column:
    """Shares to trade: scaled by strength, capped, to two decimals."""
    wanted = p.portfolio_value * p.base_size * (strength / 50.0) / price
    return F.round(F.least(wanted, p.portfolio_value * p.max_size / price), 2)


def exit_reason(
    entry_type: Column,
    price: Column,
    stop: Column,
    target: Column,
    mood: Column,
    v: Column,
    p: ContrarianParams = ContrarianParams(),
) -> Column:
    """First exit rule that holds, or NULL: stop, target, sentiment reversal, valuation reversal."""
    long = entry_type == "BUY"
    known = mood.isNotNull() & v.isNotNull()
    return (
        F.when(F.when(long, price <= stop).otherwise(price >= stop), "stop_loss")
        .when(F.when(long, price >= target).otherwise(price <= target), "take_profit")
        .when(known & F.when(long, mood > p.mood_reversal).otherwise(mood < -p.mood_reversal), "sentiment_reversal")
        .when(known & F.when(long, v < p.value_reversal).otherwise(v > p.value_reversal), "valuation_reversal")
    )


def exit_type(entry_type: Column) -> Column:
    return F.when(entry_type == "BUY", "EXIT_LONG").otherwise("EXIT_SHORT")


def position_fraction(
    strength: Column, confidence: Column, entry: Column, stop: Column, p: RouterParams = RouterParams()
) -> Column:
    """Fraction of the portfolio for one signal, before the cap."""
    base = F.lit(p.base_size)
    if p.sizing == "signal_strength":
        return base * (strength / 50.0) * confidence
    if p.sizing == "risk_parity":
        usable = entry.isNotNull() & (entry != 0) & stop.isNotNull() & (stop != 0)
        return F.when(usable, base / F.greatest(F.abs(entry - stop) / entry, F.lit(0.01))).otherwise(base)
    return base


# --- bars -------------------------------------------------------------------


def typical_price(high: Column, low: Column, close: Column) -> Column:
    return (high + low + close) / 3


def bar_range(high: Column, low: Column) -> Column:
    return high - low


def body_size(open_: Column, close: Column) -> Column:
    return F.abs(close - open_)


# --- positions and orders ---------------------------------------------------


def market_value(quantity: Column, price: Column) -> Column:
    return F.abs(quantity) * price


def return_pct(long: Column, entry: Column, price: Column) -> Column:
    return F.when(long, (price - entry) / entry).otherwise((entry - price) / entry)


def unrealised(long: Column, quantity: Column, entry: Column, price: Column) -> Column:
    return F.when(long, (price - entry) * quantity).otherwise((entry - price) * F.abs(quantity))


def order_is_active(status: Column) -> Column:
    return F.lower(status).isin(*ACTIVE_STATUSES)


def order_is_complete(status: Column) -> Column:
    return F.lower(status).isin(*FINAL_STATUSES)


def notional(quantity: Column, price: Column) -> Column:
    return quantity * price


def fill_price(side: Column, price: Column, model: str = "next_open", p: CostParams = CostParams()) -> Column:
    """Price after the fill model and slippage; ``next_open`` and ``close`` start from the price itself."""
    up = side == "BUY"
    if model == "vwap":
        price = F.when(up, price * (1 + p.vwap_premium)).otherwise(price * (1 - p.vwap_premium))
    return F.when(up, price * (1 + p.slippage)).otherwise(price * (1 - p.slippage))


def commission(value: Column, p: CostParams = CostParams()) -> Column:
    return F.greatest(value * p.commission_rate, F.lit(p.min_commission))


def stamp_duty(side: Column, value: Column, p: CostParams = CostParams()) -> Column:
    return F.when(side == "SELL", value * p.stamp_duty).otherwise(F.lit(0.0))


def exit_pnl(long: Column, fill: Column, entry: Column, quantity: Column, costs: Column) -> Column:
    return F.when(long, (fill - entry) * quantity).otherwise((entry - fill) * quantity) - costs


def request_fault(
    symbol: Column, quantity: Column, order_type: Column, price: Column, stop_price: Column
) -> Column:
    """First basic fault of an order request, or NULL."""
    return (
        F.when(symbol.isNull() | (symbol == ""), "invalid_symbol")
        .when(quantity <= 0, "invalid_quantity")
        .when(order_type.isin("limit", "stop_limit") & price.isNull(), "limit_price_missing")
        .when(order_type.isin("stop", "stop_limit") & stop_price.isNull(), "stop_price_missing")
        .when(price <= 0, "price_not_positive")
        .when(stop_price <= 0, "stop_price_not_positive")
    )


def stop_loss_hit(quantity: Column, cost: Column, price: Column, p: RiskParams = RiskParams()) -> Column:
    change = F.when(quantity > 0, (price - cost) / cost * 100).otherwise((cost - price) / cost * 100)
    return change <= -p.stop_percent
