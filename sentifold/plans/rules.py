"""Portfolio rules taken from the method's design text; off unless called."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basic import or_zero
from ..functions.trading import is_entry
from ..operators.series import with_ema, with_return


def cap_sectors(signals: DataFrame, sectors: DataFrame, limit: float = 0.25, run: Sequence[str] = ()) -> DataFrame:
    """Shrink entries of a sector in proportion where they exceed its share.

    ``signals`` come after the routing, which bounds their number per run.
    """
    df = signals.join(sectors.select("symbol", "sector"), "symbol", "left")
    size = F.when(is_entry(F.col("signal_type")), or_zero(F.col("position_size"))).otherwise(0.0)
    total = F.sum(size).over(Window.partitionBy(*run, "sector"))
    factor = F.when(is_entry(F.col("signal_type")) & F.col("sector").isNotNull() & (total > limit), limit / total)
    return df.withColumn("position_size", F.col("position_size") * F.coalesce(factor, F.lit(1.0)))


def cap_sides(signals: DataFrame, long_limit: float = 0.30, short_limit: float = 0.30, run: Sequence[str] = ()) -> DataFrame:
    """Shrink the long and the short side in proportion, each to its own limit."""
    side = F.col("signal_type")
    total = F.sum(or_zero(F.col("position_size"))).over(Window.partitionBy(*run, "signal_type"))
    limit = F.when(side == "BUY", long_limit).when(side == "SELL", short_limit)
    factor = F.when(total > limit, limit / total)
    return signals.withColumn("position_size", F.col("position_size") * F.coalesce(factor, F.lit(1.0)))


def crowded_symbols(bars: DataFrame, symbols: DataFrame, limit: float = 0.7, min_days: int = 20) -> DataFrame:
    """Candidates whose daily returns move with those of the other candidates.

    Each symbol is held against the mean return of all others on the same day, which takes one sum
    per day instead of a row per pair of symbols.
    """
    wanted = bars.join(symbols.select("symbol"), "symbol", "left_semi")
    returns = with_return(wanted, ["symbol"], ["day"]).filter("ret is not null").select("symbol", "day", "ret")
    basket = returns.groupBy("day").agg(F.sum("ret").alias("_sum"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    others = (F.col("_sum") - F.col("ret")) / (F.col("_n") - 1)
    found = (
        returns.join(basket, "day")
        .groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("n_days"), F.corr("ret", others).alias("correlation"))
    )
    return found.filter((F.col("n_days") >= min_days) & (F.col("correlation") > limit))


def liquid(bars: DataFrame, limit: float = 50_000_000.0, rows: int = 30) -> DataFrame:
    """Bars whose mean turnover of the last ``rows`` rows reaches the limit."""
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-(rows - 1), 0)
    return bars.withColumn("turnover", F.avg("amount").over(w)).filter(F.col("turnover") >= limit)


def market_regime(index: DataFrame, rows: int = 200) -> DataFrame:
    """Bull or bear per day: the index (day, close) against its own mean.  One row per day."""
    w = Window.partitionBy("_one").orderBy("day").rowsBetween(-(rows - 1), 0)
    one = index.select("day", "close").withColumn("_one", F.lit(0))
    mean = F.when(F.count(F.lit(1)).over(w) >= rows, F.avg("close").over(w))
    return one.withColumn("mean", mean).select(
        "day", "close", "mean", F.when(F.col("close") < F.col("mean"), "bear").when(F.col("close") >= F.col("mean"), "bull").alias("regime")
    )


def allowed_in_regime(signals: DataFrame, regime: DataFrame, day: str = "day") -> DataFrame:
    """In a bear market only BUY entries (and exits) remain."""
    df = signals.join(regime.select(F.col("day").alias(day), "regime"), day, "left")
    return df.filter(~((F.col("signal_type") == "SELL") & F.coalesce(F.col("regime") == "bear", F.lit(False))))


def alpha_beta(curve: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Regression of daily returns (date, ret) on those of a benchmark, one row."""
    joined = curve.select("date", F.col("ret").alias("y")).join(benchmark.select("date", F.col("ret").alias("x")), "date")
    return joined.filter("x is not null and y is not null").agg(
        F.regr_intercept("y", "x").alias("alpha"), F.regr_slope("y", "x").alias("beta"), F.count(F.lit(1)).alias("n_days")
    )


def zscore_modes(df: DataFrame, value: str, mode: str = "rolling", window: int = 20, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Z-score against a rolling, an expanding, or an exponentially weighted mean and deviation."""
    keys = list(keys)
    if mode == "ewma":
        alpha = 2.0 / (window + 1)
        # Departures from the first value keep their digits; their variance is an average too, of the squared steps away
        # from the mean before, so no squares are subtracted.
        steps = Window.partitionBy(*keys).orderBy("day")
        start = steps.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = with_ema(df.withColumn("_off", F.col(value) - F.first(value).over(start)), keys, ["day"], "_off", alpha, "_m")
        step = F.coalesce(F.col("_off") - F.lag("_m").over(steps), F.lit(0.0))
        df = with_ema(df.withColumn("_sq", (1 - alpha) * step * step), keys, ["day"], "_sq", alpha, "_var")
        std = F.sqrt("_var")
        return df.withColumn("z_score", F.when(std > 0, (F.col("_off") - F.col("_m")) / std)).drop("_off", "_m", "_sq", "_var")
    first = Window.unboundedPreceding if mode == "expanding" else -(window - 1)
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(first, 0)
    std = F.stddev_samp(value).over(w)
    enough = F.count(F.lit(1)).over(w) >= (2 if mode == "expanding" else window)
    return df.withColumn("z_score", F.when(enough & (std > 0), (F.col(value) - F.avg(value).over(w)) / std))
