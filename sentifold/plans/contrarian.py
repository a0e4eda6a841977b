"""Contrarian signals: bearish sentiment on cheap companies, bullish sentiment on dear ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trading as t
from ..operators.latest import newest_rows, top_rows
from ..params import REASONS, ContrarianParams
from ..sources.schemas import SIGNALS, conform

SOURCE = "sentiment_strategy"


def snapshot_mood(latest_scores: DataFrame, p: ContrarianParams = ContrarianParams()) -> DataFrame:
    """State from a bare score: scaled up, without change or history (so never extreme)."""
    return latest_scores.select(
        "symbol",
        (F.col("score") * p.snapshot_scale).alias("mood"),
        F.lit(0.0).alias("roc"),
        F.lit(False).alias("is_extreme"),
        F.lit(0.0).alias("extreme_value"),
        F.col("confidence").alias("mean_confidence"),
    )


def _case(mood: Column, roc: Column, v: Column, trend: Column, p: ContrarianParams) -> tuple[Column, Column, Column, Column]:
    """Conditions of the long case; the short case is the same with every sign turned."""
    strong = mood < -p.mood_limit
    fast = ~strong & (roc < -p.roc_limit)
    cheap = v > p.under
    nearing = ~cheap & (v > 0) & F.coalesce(trend > 0, F.lit(False))
    return strong, fast, cheap, nearing


def _reasons(side: str, cond, mood: Column, roc: Column, v: Column, trend: Column, label: Column, ext: Column) -> Column:
    strong, fast, cheap, nearing = cond
    text = lambda name, *values: F.format_string(REASONS[f"{side.lower()}_{name}"], *values)
    return F.array_compact(
        F.array(
            F.when(strong, text("strong", mood)),
            F.when(fast, text("fast", roc)),
            F.when(cheap, text("cheap", v, label)),
            F.when(nearing, text("nearing", v, trend)),
            F.format_string(REASONS["extreme"], ext),
        )
    )


def _exit_text(reason: Column, long: Column, price: Column, stop: Column, target: Column, mood: Column, v: Column, p) -> Column:
    def text(name: str, left: Column, right: Column) -> Column:
        sides = [F.format_string(REASONS[f"{name}_{side}"], left, right) for side in ("long", "short")]
        return F.when(long, sides[0]).otherwise(sides[1])

    return (
        F.when(reason == "stop_loss", text("stop", price, stop))
        .when(reason == "take_profit", text("target", price, target))
        .when(reason == "sentiment_reversal", text("mood", mood, F.lit(str(p.mood_reversal))))
        .when(reason == "valuation_reversal", text("value", v, F.lit(str(p.value_reversal))))
    )


def contrarian_signals(
    prices: DataFrame,
    mood: DataFrame,
    valuation: DataFrame,
    as_of,
    positions: DataFrame | None = None,
    p: ContrarianParams = ContrarianParams(),
) -> DataFrame:
    """One signal per symbol that has a price, a sentiment state and a valuation.

    ``mood``: symbol, mood, roc, is_extreme, extreme_value, mean_confidence.
    ``valuation``: symbol, v, v_label and optionally trend.
    ``positions``: held entries; their exits come before any new signal.
    All inputs hold one row per symbol.
    """
    if "trend" not in valuation.columns:
        valuation = valuation.withColumn("trend", F.lit(None).cast("double"))
    df = prices.select("symbol", "price").join(mood, "symbol").join(
        valuation.select("symbol", "v", "v_label", "trend"), "symbol"
    )
    c = {n: F.col(n) for n in ("price", "mood", "roc", "v", "trend", "v_label", "extreme_value")}
    if positions is None:
        df = df.withColumn("_exit", F.lit(None).cast("string")).withColumn("_exit_type", F.lit(None).cast("string"))
        exit_text = F.lit(None).cast("string")
    else:
        held = positions.select(
            "symbol", F.col("entry_type").alias("_held"), F.col("stop_loss").alias("_stop"),
            F.col("take_profit").alias("_target"),
        )
        df = df.join(held, "symbol", "left")
        why = t.exit_reason(F.col("_held"), c["price"], F.col("_stop"), F.col("_target"), c["mood"], c["v"], p)
        df = df.withColumn("_exit", F.when(F.col("_held").isNotNull(), why)).withColumn(
            "_exit_type", t.exit_type(F.col("_held"))
        )
        exit_text = _exit_text(
            F.col("_exit"), F.col("_held") == "BUY", c["price"], F.col("_stop"), F.col("_target"), c["mood"], c["v"], p
        )

    # The limits are symmetric only if under = -over; the short case passes its own.
    short = ContrarianParams(**{**p.__dict__, "under": -p.over})
    buy_cond = _case(c["mood"], c["roc"], c["v"], c["trend"], p)
    sell_cond = _case(-c["mood"], -c["roc"], -c["v"], -c["trend"], short)
    met = lambda k: (k[0] | k[1]) & (k[2] | k[3]) & F.col("is_extreme")
    df = df.withColumns(
        {
            "_buy": met(buy_cond),
            "_sell": met(sell_cond),
            "_buy_strength": t.conviction(c["mood"], c["v"], p),
            "_sell_strength": t.conviction(-c["mood"], -c["v"], p),
        }
    )
    buy, sell, exiting = F.col("_buy"), F.col("_sell"), F.col("_exit").isNotNull()
    long_wins = buy & (~sell | (F.col("_buy_strength") >= F.col("_sell_strength")))
    entry = F.when(long_wins, "BUY").when(sell, "SELL").otherwise("HOLD")
    df = df.withColumn("_entry", entry)
    strength = (
        F.when(F.col("_entry") == "BUY", F.col("_buy_strength"))
        .when(F.col("_entry") == "SELL", F.col("_sell_strength"))
        .otherwise(0.0)
    )
    df = df.withColumn("strength", F.when(exiting, 100.0).otherwise(strength))
    sized = ~exiting & t.is_entry(F.col("_entry")) & (F.col("strength") > p.sizing_strength)
    df = df.withColumn("_shares", F.when(sized, t.share_count(F.col("strength"), c["price"], p)))
    own = F.col("strength") / 100.0
    reasons = (
        F.when(exiting, F.array(exit_text))
        .when(F.col("_entry") == "BUY", _reasons("BUY", buy_cond, c["mood"], c["roc"], c["v"], c["trend"], c["v_label"], c["extreme_value"]))
        .when(F.col("_entry") == "SELL", _reasons("SELL", sell_cond, c["mood"], c["roc"], c["v"], c["trend"], c["v_label"], c["extreme_value"]))
        .otherwise(F.array(F.lit("No clear signal")))
    )
    level = lambda f, pct: F.when(~exiting, f(F.col("_entry"), c["price"], pct))
    out = df.withColumns(
        {
            "signal_type": F.when(exiting, F.col("_exit_type")).otherwise(F.col("_entry")),
            "ts": F.lit(as_of).cast("timestamp_ntz"),
            "source": F.lit(SOURCE),
            "confidence": F.when(exiting, 1.0).otherwise(
                F.when(F.col("mean_confidence").isNotNull(), (own + F.col("mean_confidence")) / 2).otherwise(own)
            ),
            "entry_price": c["price"],
            "stop_loss": level(t.stop_level, p.stop),
            "take_profit": level(t.target_level, p.target),
            "position_size": F.col("_shares") * c["price"] / p.portfolio_value,
            "quantity": F.when(F.col("_shares") != 0, F.floor("_shares")),
            "sentiment_score": c["mood"],
            "valuation_score": c["v"],
            "reasons": reasons,
            "metadata": F.when(exiting, F.create_map(F.lit("exit_reason"), F.col("_exit_type"))).otherwise(
                F.create_map().cast("map<string,string>")
            ),
        }
    )
    return conform(out, SIGNALS)


def held_exits(positions: DataFrame, prices: DataFrame, mood: DataFrame, valuation: DataFrame, p: ContrarianParams = ContrarianParams()) -> DataFrame:
    """Positions to close and the first rule that says so.  Positions without a price stay."""
    df = (
        positions.join(prices.select("symbol", "price"), "symbol")
        .join(mood.select("symbol", "mood"), "symbol", "left")
        .join(valuation.select("symbol", "v"), "symbol", "left")
    )
    why = t.exit_reason(
        F.col("entry_type"), F.col("price"), F.col("stop_loss"), F.col("take_profit"), F.col("mood"), F.col("v"), p
    )
    return df.withColumn("reason", why).filter("reason is not null").withColumn(
        "signal_type", t.exit_type(F.col("entry_type"))
    )


def bounded_history(signals: DataFrame, rows: int = ContrarianParams.history_rows) -> DataFrame:
    """The newest signals per symbol."""
    return newest_rows(signals, ["symbol"], ["ts", "source"], rows)


def recent_signals(signals: DataFrame, limit: int, symbol: str | None = None) -> DataFrame:
    rows = signals if symbol is None else signals.filter(F.col("symbol") == symbol)
    return top_rows(rows, limit, F.desc("ts"), "symbol", "source")
