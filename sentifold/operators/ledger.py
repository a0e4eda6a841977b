"""Ledgers of fills: first-in-first-out pairing and average-cost positions, for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .affine import affine_scan
from .segments import ROWS_PER_TASK, ordered, running

# Rows folded at a time.
FOLD = 8192


def fifo_ranks(
    trades: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Number BUY and SELL rows so that equal numbers belong together (``pair_no``).

    A SELL takes the oldest open BUY; with none open it pairs with nothing and gets NULL.
    With S the running sum of +1/-1 before a row and L its running minimum, S - L BUYs are open
    and -L SELLs have gone without a partner, so a paired SELL is numbered by the SELLs so far
    less those.
    """
    buy = F.col("side") == "BUY"
    step = F.when(buy, 1).otherwise(-1).cast("long")
    before = F.col("_level") - step
    counted = running(
        ordered(trades, keys, order, limit),
        {
            "_level": ("sum", step),
            "_buys": ("sum", buy.cast("long")),
            "_sells": ("sum", (~buy).cast("long")),
        },
    )
    ranked = running(counted, {"_low": ("min", before)}).rows()
    open_buys = before - F.col("_low")
    return ranked.withColumn(
        "pair_no",
        F.when(buy, F.col("_buys")).when(open_buys > 0, F.col("_sells") + F.col("_low")),
    ).drop("_level", "_buys", "_sells", "_low")


def fifo_pairs(
    trades: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], limit: int | None = None
) -> DataFrame:
    """One row per closed round trip with the carried columns of both sides.

    Both sides meet in a group of two rows, (key, pair_no), so a large key spreads over all tasks.
    """
    ranked = fifo_ranks(trades.select(*keys, *order, "side", *(c for c in carry if c not in order)), keys, order, limit)
    halves = [
        F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side.lower()}_{c}")
        for side in ("BUY", "SELL")
        for c in carry
    ]
    return (
        ranked.filter(F.col("pair_no").isNotNull())
        .groupBy(*keys, "pair_no")
        .agg(F.count(F.lit(1)).alias("_n"), *halves)
        .filter("_n = 2")
        .drop("_n")
    )


# State of the average-cost fold, as a map of the cost c and the open profit r that come in:
#   cost out        = a*c + b
#   profit so far  += g*c + h
#   open profit out = k*r + p*c + q        (forgotten when the position goes flat)
_STATE = ("a", "b", "g", "h", "k", "p", "q")


def _fill_step(qty: Column, price: Column, before: Column) -> dict[str, Column]:
    """What one signed fill does, given the quantity held before it."""
    after = before + qty
    sign = F.signum(before)
    opening = (before == 0) | (F.signum(after) * sign < 0)
    adding = ~opening & (qty * sign > 0)
    closed = F.when(qty * sign < 0, F.least(F.abs(qty), F.abs(before))).otherwise(F.lit(0))
    stays = F.when(after == 0, 0.0).otherwise(1.0)
    g, h = -sign * closed, sign * closed * price
    return {
        "a": F.when(opening, 0.0).when(adding, before / F.when(after != 0, after)).otherwise(1.0),
        "b": F.when(opening, price).when(adding, price * qty / F.when(after != 0, after)).otherwise(0.0),
        "g": g.cast("double"),
        "h": h.cast("double"),
        "k": stays,
        "p": (stays * g).cast("double"),
        "q": (stays * h).cast("double"),
    }


def _then(s: Column, e: Column) -> Column:
    """State after ``s`` followed by ``e`` (maps compose, so folds may be nested)."""
    return F.struct(
        (e["a"] * s["a"]).alias("a"),
        (e["a"] * s["b"] + e["b"]).alias("b"),
        (s["g"] + e["g"] * s["a"]).alias("g"),
        (s["h"] + e["g"] * s["b"] + e["h"]).alias("h"),
        (e["k"] * s["k"]).alias("k"),
        (e["k"] * s["p"] + e["p"] * s["a"]).alias("p"),
        (e["k"] * s["q"] + e["p"] * s["b"] + e["q"]).alias("q"),
    )


def _fold(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fold the rows of each group in ``idx`` order; groups hold at most FOLD rows."""
    start = F.struct(*(F.lit(1.0 if n in ("a", "k") else 0.0).alias(n) for n in _STATE))
    rows = F.array_sort(F.collect_list(F.struct("idx", *_STATE)))
    folded = df.groupBy(*by).agg(
        rows.alias("_rows"), F.sum("qty").alias("qty"), F.sum("n_fills").alias("n_fills"),
        F.max(F.struct("last_at", "last_price")).alias("_last"),
    )
    return folded.withColumn("_s", F.aggregate("_rows", start, _then)).select(
        *by, "_s.*", "qty", "n_fills", "_last.last_at", "_last.last_price"
    )


def _steps(
    fills: DataFrame, keys: Sequence[str], order: Sequence[str], qty: str, price: str, limit: int | None
) -> tuple[DataFrame, int]:
    """Each fill with its position, the quantity held after it and what it does to the cost; and the
    rows of the largest key."""
    moved = fills.select(*keys, *order, F.col(qty).alias("qty"), F.col(price).alias("price")).filter("qty <> 0")
    one = running(
        ordered(moved, keys, order, limit),
        {"held": ("sum", F.col("qty")), "idx": ("sum", F.lit(1).cast("long"))},
    )
    before = F.col("held") - F.col("qty")
    steps = one.rows().withColumn("idx", F.col("idx") - 1).withColumns(_fill_step(F.col("qty"), F.col("price"), before))
    return steps, one.largest


def average_cost_book(
    fills: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    qty: str = "qty",
    price: str = "price",
    limit: int | None = None,
    fold: int = FOLD,
) -> DataFrame:
    """Quantity, average cost and realised profit per key from signed fills.

    Adding moves the cost to the weighted mean, reducing realises profit at the standing cost,
    crossing zero restarts at the fill price.  The quantity is a running sum; given it, each fill
    maps the cost affinely, and such maps compose.  So the fold runs in short stretches of one key
    in parallel and then over the stretches, as many times as the largest key needs.
    """
    steps, length = _steps(fills, keys, order, qty, price, limit)
    steps = steps.select(
        *keys,
        "idx",
        "qty",
        F.lit(1).cast("long").alias("n_fills"),
        F.col("idx").alias("last_at"),
        F.col("price").alias("last_price"),
        *_STATE,
    )
    while length > fold:
        by = [*keys, "chunk"]
        steps = _fold(steps.withColumn("chunk", F.floor(F.col("idx") / fold)), by).withColumnRenamed("chunk", "idx")
        length = -(-length // fold)
    book = _fold(steps, keys)
    open_ = F.col("qty") != 0
    return book.select(
        *keys,
        F.col("qty").alias("quantity"),
        F.when(open_, F.col("b")).alias("avg_cost"),
        F.col("last_price"),
        F.col("h").alias("realised_all"),
        F.when(open_, F.col("q")).otherwise(0.0).alias("realised_open"),
        "n_fills",
    )


def cost_ledger(
    fills: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    qty: str = "qty",
    price: str = "price",
    limit: int | None = None,
    stretch: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every fill with the quantity held and the average cost after it, and the profit it realised."""
    steps, largest = _steps(fills, keys, order, qty, price, limit)
    cost = affine_scan(steps, keys, "idx", "a", "b", "cost_before", largest, stretch)
    before = F.col("cost_before")
    return cost.select(
        *keys,
        *order,
        "qty",
        "price",
        F.col("held").alias("quantity_after"),
        F.when(F.col("held") != 0, F.col("a") * before + F.col("b")).alias("avg_cost_after"),
        (F.col("g") * before + F.col("h")).alias("realised"),
    )
