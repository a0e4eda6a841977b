"""Candidates whose daily returns move together, and a choice among them without any such pair.

Returns of a symbol over the market's latest days become a vector of length 1 around its mean; two of them lie at a distance of
sqrt(2 - 2 * correlation).  Distances to a few pivots put every vector into a cell of a grid whose cells are as wide as the
distance at the limit, so by the triangle inequality partners lie in the same or a neighbouring cell and no pair is lost.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable
from ..operators.series import with_return

# Pivots that span the grid, and pivots whose distances a pair is held against besides.
GRID, PIVOTS = 3, 8
# Vectors of a cell that one task of the join meets; a fuller cell is dealt to several.
PER_BLOCK = 2000
# More than the rounding of a distance.
EPS = 1e-6


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def return_vectors(bars: DataFrame, symbols: DataFrame, days: int = 60, min_days: int = 20) -> DataFrame:
    """(symbol, z): returns of the market's latest days less their mean, at length 1.

    ``bars`` hold symbol, day, close.  A day without a return of the symbol counts as unchanged.  Symbols with fewer than ``min_days``
    returns, or whose returns never differ, have no correlation and no row.
    """
    latest = [r["day"] for r in bars.select("day").distinct().orderBy(F.desc("day")).limit(days).collect() if r["day"] is not None]
    if not latest:
        return bars.sparkSession.createDataFrame([], "symbol string, z array<double>")
    wanted = bars.join(symbols.select("symbol"), "symbol", "left_semi")
    returns = with_return(wanted, ["symbol"], ["day"]).filter(F.col("ret").isNotNull() & F.col("day").isin(latest))
    returns = returns.groupBy("symbol", "day").agg(F.max("ret").alias("ret"))
    calendar = F.array(*[F.lit(d) for d in sorted(latest)])
    by_day = returns.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("day", "ret"))).alias("m"))  # at most `days` entries
    filled = F.transform(calendar, lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)))
    rows = by_day.filter(F.size("m") >= min_days).select("symbol", filled.alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, v: s + v) / len(latest)
    rows = rows.withColumn("mean", mean).select("symbol", F.transform("v", lambda v: v - F.col("mean")).alias("v"))
    rows = rows.withColumn("norm", F.sqrt(_dot(F.col("v"), F.col("v")))).filter("norm > 1e-12")
    return rows.select("symbol", F.transform("v", lambda v: v / F.col("norm")).alias("z"))


def close_pairs(vectors: DataFrame, limit: float = 0.7, per_block: int = PER_BLOCK) -> DataFrame:
    """(symbol_a, symbol_b, correlation) of every pair above the limit, symbol_a before symbol_b."""
    if not -1 <= limit < 1:
        raise ValueError("a correlation limit lies from -1 to below 1")
    radius = math.sqrt(2 - 2 * limit) + EPS
    vectors = durable(vectors)
    pivots = [r["z"] for r in vectors.orderBy(F.xxhash64("symbol"), "symbol").limit(PIVOTS).collect()]
    if not pivots:
        return vectors.sparkSession.createDataFrame([], "symbol_a string, symbol_b string, correlation double")
    away = [F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * _dot(F.col("z"), F.array(*[F.lit(float(x)) for x in p])))) for p in pivots]
    rows = vectors.withColumn("d", F.array(*away))
    axes = range(min(GRID, len(pivots)))
    rows = durable(rows.withColumn("cell", F.array(*[F.floor(F.col("d")[k] / radius) for k in axes])))

    # A full cell's vectors are dealt to blocks; whoever looks for partners in the cell meets every block.
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / per_block).alias("blocks"))
    block = F.pmod(F.xxhash64("symbol"), F.col("blocks"))
    there = rows.join(sizes, "cell").select("cell", block.alias("block"), *[F.col(c).alias(f"{c}_b") for c in ("symbol", "z", "d")])
    steps = [F.array(*[F.col("cell")[k] + s for k, s in zip(axes, step, strict=True)]) for step in itertools.product((-1, 0, 1), repeat=len(axes))]
    here = rows.select(F.col("symbol").alias("symbol_a"), F.col("z").alias("z_a"), F.col("d").alias("d_a"), F.explode(F.array(*steps)).alias("cell"))
    here = here.join(sizes, "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
    within = [F.abs(F.col("d_a")[k] - F.col("d_b")[k]) <= radius for k in range(len(pivots))]
    same = (here["cell"] == there["cell"]) & (here["block"] == there["block"]) & (F.col("symbol_a") < F.col("symbol_b"))
    for bound in within:
        same = same & bound
    met = here.join(there, same & (_dot(F.col("z_a"), F.col("z_b")) > limit))
    return met.select("symbol_a", "symbol_b", _dot(F.col("z_a"), F.col("z_b")).alias("correlation"))


def correlated_pairs(bars: DataFrame, symbols: DataFrame, limit: float = 0.7, days: int = 60, min_days: int = 20) -> DataFrame:
    """Every pair of the candidates whose returns correlate above the limit."""
    return close_pairs(return_vectors(bars, symbols, days, min_days), limit)


def uncorrelated(candidates: DataFrame, pairs: DataFrame, priority: str | None = None) -> DataFrame:
    """The candidates that stay when each, best first, goes if it is paired with a better one that stays.

    Best is the greatest priority (NULL last), then the smallest symbol; without a priority the order is random but fixed, which ends
    in a number of rounds that grows with the logarithm of the candidates.  In each round those without a better partner stay
    and their partners go.  Pairs with a symbol that is no candidate count for nothing; a repeated candidate keeps its rows.
    """
    worth = F.xxhash64("symbol") if priority is None else F.col(priority)
    ranked = candidates.groupBy("symbol").agg(F.max(worth).alias("p"))
    a, b = (ranked.select(F.col("symbol").alias(f"symbol_{x}"), F.col("p").alias(f"p_{x}")) for x in "ab")
    linked = pairs.filter("symbol_a <> symbol_b").join(a, "symbol_a").join(b, "symbol_b")
    tie = F.col("p_a").eqNullSafe(F.col("p_b")) & (F.col("symbol_a") < F.col("symbol_b"))
    first = F.coalesce(F.col("p_a") > F.col("p_b"), F.col("p_a").isNotNull() & F.col("p_b").isNull()) | tie
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    links = durable(linked.select(pick("symbol_a", "symbol_b").alias("better"), pick("symbol_b", "symbol_a").alias("worse")).distinct())
    gone = links.select(F.col("worse").alias("symbol")).limit(0)
    while not links.isEmpty():
        staying = links.select("better").distinct().join(links.select(F.col("worse").alias("better")), "better", "left_anti")
        out = links.join(staying, "better", "left_semi").select(F.col("worse").alias("symbol")).distinct()
        out = durable(out)
        gone = gone.unionByName(out)
        for side in ("better", "worse"):
            links = links.join(out.withColumnRenamed("symbol", side), side, "left_anti").select("better", "worse")
        links = durable(links)
    return candidates.join(gone, "symbol", "left_anti")
