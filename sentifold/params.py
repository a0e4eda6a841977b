"""Parameters of the library.  Every number below is a fixed value of the method."""

from __future__ import annotations

from dataclasses import dataclass, field

# Source weights of the blended score.
SOURCE_WEIGHTS = {"news": 0.40, "social": 0.35, "search": 0.15, "forum": 0.10}

# Signal types.
ENTRY_TYPES = ("BUY", "SELL")
EXIT_TYPES = ("EXIT", "EXIT_LONG", "EXIT_SHORT")

# Order life cycle.
ACTIVE_STATUSES = ("pending", "partially_filled")
FINAL_STATUSES = ("filled", "cancelled", "rejected", "expired")

# Vendor table headers (first name found wins).
CODE_HEADERS = ("代码", "股票代码")
MARGIN_CODE_HEADERS = ("标的证券代码", "证券代码", "代码")
SPOT_CHANGE_HEADERS = ("涨跌幅",)
SPOT_VOLUME_HEADERS = ("成交量",)
DRAGON_TIGER_HEADERS = ("龙虎榜净买额",)
NORTHBOUND_HEADERS = ("5日增持估计-占流通股比", "持股变动")
MAIN_FLOW_HEADERS = ("主力净流入",)
RETAIL_FLOW_HEADERS = ("散户净流入",)
MARGIN_BALANCE_HEADERS = ("融资余额",)


@dataclass(frozen=True)
class MoodParams:
    """Sentiment time series."""

    weights: dict[str, float] = field(default_factory=lambda: dict(SOURCE_WEIGHTS))
    alpha: float = 0.2
    roc_limit: float = 1.0
    floor: float = -5.0
    ceiling: float = 5.0
    very_low: float = -3.0
    low: float = -1.5
    high: float = 1.5
    very_high: float = 3.0
    warmup_rows: int = 10
    warmup_limit: float = 2.0
    stats_rows: int = 30
    min_std: float = 0.01
    extreme_std: float = 1.5


@dataclass(frozen=True)
class ValueParams:
    """Relative valuation."""

    pe_weight: float = 0.40
    pb_weight: float = 0.25
    dividend_weight: float = 0.15
    peg_weight: float = 0.20
    deep_under: float = 0.30
    under: float = 0.10
    over: float = -0.10
    deep_over: float = -0.30
    market_pe: float = 15.0
    market_pb: float = 2.0
    market_dividend: float = 0.02
    market_peg: float = 1.5
    growth: float = 0.03


@dataclass(frozen=True)
class ContrarianParams:
    """Sentiment against valuation."""

    mood_limit: float = 1.5
    roc_limit: float = 1.0
    extreme_std: float = 1.5
    under: float = 0.10
    over: float = -0.10
    stop: float = 0.08
    target: float = 0.15
    mood_reversal: float = 1.0
    value_reversal: float = 0.05
    base_size: float = 0.01
    max_size: float = 0.05
    mood_share: float = 0.5
    value_share: float = 0.5
    mood_scale: float = 3.5
    value_cap: float = 0.5
    sizing_strength: float = 20.0
    portfolio_value: float = 100000.0
    snapshot_scale: float = 3.0
    confirm_rows: int = 2
    history_rows: int = 100


@dataclass(frozen=True)
class DislocationParams:
    """Sentiment against the z-score of returns."""

    lookback_days: int = 252
    min_rows: int = 20
    long_mood: float = 1.5
    long_z: float = -0.5
    long_gap: float = 2.0
    short_mood: float = -1.5
    short_z: float = 0.5
    short_gap: float = -2.0
    stop: float = 0.15
    target: float = 0.20
    confidence: float = 0.7


@dataclass(frozen=True)
class MomentumParams:
    lookback_days: int = 30
    min_rows: int = 20
    fast: int = 5
    slow: int = 20
    limit: float = 0.005
    strength_factor: float = 5000.0
    stop: float = 0.08
    target: float = 0.15
    confidence: float = 0.6


@dataclass(frozen=True)
class MeanMoodParams:
    lookback_days: int = 5
    limit: float = 0.5
    strength_factor: float = 50.0
    confidence: float = 0.7


@dataclass(frozen=True)
class BreakoutParams:
    lookback_days: int = 30
    rows: int = 20
    margin: float = 1.02
    strength: float = 50.0
    confidence: float = 0.5


@dataclass(frozen=True)
class RouterParams:
    """Merging the signals of several strategies."""

    min_confidence: float = 0.3
    min_strength: float = 30.0
    require_agreement: bool = False
    max_size: float = 0.05
    max_exposure: float = 1.0
    max_long_short_ratio: float = 2.0
    sizing: str = "signal_strength"
    base_size: float = 0.02
    max_signals: int = 50
    cooldown_minutes: int = 60
    arbitrage_weight: float = 0.6
    contrarian_weight: float = 0.4


@dataclass(frozen=True)
class CostParams:
    """Trading costs and the performance report."""

    commission_rate: float = 0.0003
    min_commission: float = 5.0
    slippage: float = 0.001
    stamp_duty: float = 0.001
    vwap_premium: float = 0.001
    initial_capital: float = 1000000.0
    drawdown_stop: float = 0.20
    trading_days: int = 252


@dataclass(frozen=True)
class RiskParams:
    """Limits of the order screen."""

    max_position: int = 10000
    max_total_value: float = 1000000.0
    max_positions: int = 10
    max_daily_loss: float = 5000.0
    stop_percent: float = 5.0
    max_order_value: float = 100000.0


# The published reason texts, with their decimals.
REASONS = {
    "buy_strong": "Sentiment bearish: %.2f",
    "buy_fast": "Sentiment rapidly deteriorating: ROC %.2f",
    "buy_cheap": "Undervalued: V=%.3f (%s)",
    "buy_nearing": "Approaching undervaluation: V=%.3f, trend=%.3f",
    "sell_strong": "Sentiment bullish: %.2f",
    "sell_fast": "Sentiment rapidly improving: ROC %.2f",
    "sell_cheap": "Overvalued: V=%.3f (%s)",
    "sell_nearing": "Approaching overvaluation: V=%.3f, trend=%.3f",
    "extreme": "Sentiment extreme: %.2f std devs from mean",
    "stop_long": "Stop-loss hit: %.2f <= %.2f",
    "stop_short": "Stop-loss hit: %.2f >= %.2f",
    "target_long": "Take-profit hit: %.2f >= %.2f",
    "target_short": "Take-profit hit: %.2f <= %.2f",
    "mood_long": "Sentiment reversal: %.2f > %s",
    "mood_short": "Sentiment reversal: %.2f < -%s",
    "value_long": "Valuation reversal: %.3f < %s",
    "value_short": "Valuation reversal: %.3f > %s",
    "disagreement": "Conflicting signals dropped due to require_agreement",
    "dislocation": "Sentiment: %.2f, Z-score: %.2f, Dislocation: %.2f",
    "points_buy_mood": "Bearish sentiment: %.2f",
    "points_sell_mood": "Bullish sentiment: %.2f",
    "points_buy_value": "Undervalued: %.2f",
    "points_sell_value": "Overvalued: %.2f",
    "momentum_up": "Positive momentum: %.4f",
    "momentum_down": "Negative momentum: %.4f",
    "mean_mood_up": "Bullish sentiment: %.2f",
    "mean_mood_down": "Bearish sentiment: %.2f",
    "breakout": "Price %.2f > MA20 %.2f",
}
