"""Merging the signals of several strategies into one sized portfolio per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trading as t
from ..functions.basic import or_zero
from ..params import ENTRY_TYPES, EXIT_TYPES, REASONS, RouterParams

# The six attributes a merge averages.
AVERAGED = ("strength", "entry_price", "stop_loss", "take_profit", "sentiment_score", "valuation_score")
# What a signal keeps when it passes through unmerged.
CARRIED = (
    "signal_type", "ts", "source", "strength", "confidence", "entry_price", "stop_loss", "take_profit",
    "position_size", "quantity", "sentiment_score", "valuation_score", "price_z_score", "dislocation",
    "reasons", "metadata",
)


def weight_of(source: Column, weights: dict[str, float]) -> Column:
    """Weight of a strategy, 1.0 for one without."""
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))))
    return F.coalesce(table[source], F.lit(1.0))


def passing(signals: DataFrame, p: RouterParams = RouterParams()) -> DataFrame:
    return signals.filter((F.col("confidence") >= p.min_confidence) & (F.col("strength") >= p.min_strength))


def signals_of(signals: DataFrame, types: Sequence[str] = (), symbols: Sequence[str] = ()) -> DataFrame:
    """Signals of some types and some symbols; an empty list lets all pass.  Both reach the scan as filters."""
    for column, wanted in (("signal_type", types), ("symbol", symbols)):
        if wanted:
            signals = signals.filter(F.col(column).isin(*wanted))
    return signals


def resolve(
    signals: DataFrame, weights: dict[str, float], p: RouterParams = RouterParams(), run: Sequence[str] = ()
) -> DataFrame:
    """One signal per symbol (and run): exits first, else the side with the greater vote, merged.

    A group holds one signal per strategy.  Everything is one conditional aggregate: one shuffle, with
    partial aggregation, and the only lists kept are the distinct reasons and strategies.
    """
    keys = [*run, "symbol"]
    kind, exit_ = F.col("signal_type"), t.is_exit(F.col("signal_type"))
    wc = F.col("_w") * F.col("confidence")
    row = F.struct(*CARRIED)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.min_by(row, F.when(exit_, F.struct(-F.col("strength"), F.col("source")))).alias("exit_row"),
        F.min_by(row, F.col("source")).alias("only_row"),
        F.min("ts").alias("first_ts"),
    ]
    for side in ENTRY_TYPES:
        here = kind == side
        aggs += [
            F.count_if(here).alias(f"{side}_n"),
            F.sum(F.when(here, F.col("_w") * F.col("strength") * F.col("confidence"))).alias(f"{side}_vote"),
            F.sum(F.when(here, wc)).alias(f"{side}_wc"),
            F.max(F.when(here, F.col("ts"))).alias(f"{side}_ts"),
            F.min_by(row, F.when(here, F.col("source"))).alias(f"{side}_row"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(here, F.col("reasons")))))).alias(
                f"{side}_reasons"
            ),
            F.array_sort(F.collect_set(F.when(here, F.col("source")))).alias(f"{side}_sources"),
        ]
        for a in AVERAGED:
            has = here & F.col(a).isNotNull()
            aggs.append((F.sum(F.when(has, F.col(a) * wc)) / F.sum(F.when(has, wc))).alias(f"{side}_{a}"))

    live = signals.filter(kind.isin(*ENTRY_TYPES, *EXIT_TYPES)).withColumn("_w", weight_of(F.col("source"), weights))
    g = live.groupBy(*keys).agg(*aggs)
    types = dict(live.select(*CARRIED).dtypes)
    null = lambda name: F.lit(None).cast(types[name])

    def merged(side: str) -> Column:
        values = {
            "signal_type": F.lit(side),
            "ts": F.col(f"{side}_ts"),
            "source": F.lit("router"),
            "confidence": F.col(f"{side}_wc") / F.col(f"{side}_n"),
            "reasons": F.col(f"{side}_reasons"),
            "metadata": F.create_map(F.lit("merged_from"), F.array_join(f"{side}_sources", ",")),
            **{a: F.col(f"{side}_{a}") for a in AVERAGED},
        }
        values["strength"] = or_zero(values["strength"])
        built = F.struct(*(values.get(n, null(n)).cast(types[n]).alias(n) for n in CARRIED))
        return F.when(F.col(f"{side}_n") == 1, F.col(f"{side}_row")).otherwise(built)

    dropped = {
        "signal_type": F.lit("HOLD"), "ts": F.col("first_ts"), "source": F.lit("router"), "strength": F.lit(0.0),
        "confidence": F.lit(0.0),
        "reasons": F.array(F.lit(REASONS["disagreement"])),
    }
    hold = F.struct(*(dropped.get(n, null(n)).cast(types[n]).alias(n) for n in CARRIED))
    mixed = (F.col("BUY_n") > 0) & (F.col("SELL_n") > 0)
    buys_win = F.when(mixed, F.col("BUY_vote") > F.col("SELL_vote")).otherwise(F.col("BUY_n") > 0)
    voted = F.when(buys_win, merged("BUY")).otherwise(merged("SELL"))
    single, exits = F.col("n") == 1, F.col("exit_row").isNotNull()
    chosen = F.when(single, F.col("only_row")).when(exits, F.col("exit_row"))
    how = F.when(single, "single").when(exits, "exit_priority")
    if p.require_agreement:
        chosen, how = chosen.when(mixed, hold), how.when(mixed, "dropped")
    else:
        how = how.when(mixed, "weighted")
    picked = g.select(*keys, chosen.otherwise(voted).alias("s"), how.otherwise("consensus").alias("resolution"))
    return picked.select(*keys, "s.*", "resolution")


def sized(signals: DataFrame, p: RouterParams = RouterParams()) -> DataFrame:
    wanted = t.position_fraction(
        F.col("strength"), F.col("confidence"), F.col("entry_price"), F.col("stop_loss"), p
    )
    size = F.least(F.coalesce(F.col("position_size"), wanted), F.lit(p.max_size))
    return signals.withColumn("position_size", size)


def strongest(signals: DataFrame, p: RouterParams = RouterParams(), run: Sequence[str] = ()) -> DataFrame:
    """The strongest signals, up to the number a run may emit."""
    rank = F.col("strength") * F.col("confidence")
    if not run:
        return signals.orderBy(F.desc(rank), "symbol").limit(p.max_signals)
    w = Window.partitionBy(*run).orderBy(F.desc(rank), "symbol")
    return signals.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= p.max_signals).drop("_r")


def scaled(signals: DataFrame, p: RouterParams = RouterParams(), run: Sequence[str] = ()) -> DataFrame:
    """Shrink entries in proportion where their total exposure passes the limit.

    Comes after ``strongest``: a run holds at most ``max_signals`` rows here.
    """
    entry = t.is_entry(F.col("signal_type"))
    total = F.sum(F.when(entry, or_zero(F.col("position_size")))).over(Window.partitionBy(*run))
    factor = F.when(entry & (F.col("_total") > p.max_exposure), p.max_exposure / F.col("_total")).otherwise(1.0)
    return (
        signals.withColumn("_total", total)
        .withColumn("position_size", F.col("position_size") * factor)
        .drop("_total")
    )


def route(
    signals: DataFrame, weights: dict[str, float], p: RouterParams = RouterParams(), run: Sequence[str] = ()
) -> DataFrame:
    """Filter, resolve, size, limit and scale.  ``run`` columns keep several runs apart."""
    one = resolve(passing(signals, p), weights, p, run)
    return scaled(strongest(sized(one, p), p, run), p, run)


def portfolio_summary(signals: DataFrame, run: Sequence[str] = (), p: RouterParams = RouterParams()) -> DataFrame:
    """Counts and exposures of a run; a ratio of long to short exposure past the limit is flagged."""
    long, short = F.col("signal_type") == "BUY", F.col("signal_type") == "SELL"
    size = or_zero(F.col("position_size"))
    ratio = F.when(F.col("_sold") > 0, F.col("_bought") / F.col("_sold"))
    bought = or_zero(F.sum(F.when(long, size)))
    sold = or_zero(F.sum(F.when(short, size)))
    return signals.groupBy(*run).agg(
        F.count_if(long).alias("long_count"),
        F.count_if(short).alias("short_count"),
        (bought + sold).alias("total_exposure"),
        (bought - sold).alias("net_exposure"),
        or_zero(F.max(size)).alias("max_single_position"),
        F.count(F.lit(1)).alias("signal_count"),
        bought.alias("_bought"),
        sold.alias("_sold"),
    ).withColumns(
        {"long_short_ratio": ratio, "ratio_exceeded": F.coalesce(ratio > p.max_long_short_ratio, F.lit(False))}
    ).drop("_bought", "_sold")
