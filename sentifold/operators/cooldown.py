"""Greedy acceptance with a pause after each accepted row, for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import micros
from .durable import durable
from .segments import SEGMENT, ordered

# Earlier than any time, in microseconds: nothing accepted yet.
NEVER = -(2**62)


def _chain_ends(times: np.ndarray, pause: int) -> np.ndarray:
    """For a chain of acceptances starting at each row: the time of its last acceptance."""
    n = len(times)
    jump = np.append(np.searchsorted(times, times + pause, side="left"), n)
    last = np.append(times, NEVER)
    end = np.arange(n + 1)
    while True:  # pointer doubling: log2(rows) rounds
        open_ = jump < n
        if not open_.any():
            return last[end[:n]]
        end = np.where(open_, end[jump], end)
        jump = np.where(open_, jump[jump], jump)


def _summary(pause: int):
    """One row per stretch: where a chain may start in it, and where that chain ends.

    A chain enters a stretch within one pause of its first row, so only those starts are listed,
    and equal ends are listed once, by their latest start.
    """

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_us"].to_numpy())
        ends = _chain_ends(times, pause)
        head = int(np.searchsorted(times, times[0] + pause, side="left")) + 1
        starts, ends = times[:head], ends[:head]
        keep = np.append(ends[1:] != ends[:-1], True)
        row = pdf.iloc[[0]].drop(columns=["_us"]).copy()
        row["first"], row["starts"], row["ends"] = int(times[0]), [starts[keep].tolist()], [ends[keep].tolist()]
        return row

    return of


def after(starts: np.ndarray, ends: np.ndarray, last: np.ndarray, pause: int) -> np.ndarray:
    """The last acceptance behind a summarised stretch, given that before it."""
    at = np.searchsorted(starts, last + pause, side="left")
    return np.where(at < len(starts), np.append(ends, NEVER)[at], last)


def composed(first: int, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], pause: int) -> tuple[np.ndarray, np.ndarray]:
    """The summary of two neighbours: one step function after the other; ``first`` is the first time of the left one.

    Starts of the right one count only where all rows of the left one lie within a pause of its first.
    """
    more = right[0] > left[0][-1]
    starts = np.concatenate([left[0], right[0][more]])
    ends = np.concatenate([after(*right, left[1], pause), right[1][more]])
    head = int(np.searchsorted(starts, first + pause, side="left")) + 1
    starts, ends = starts[:head], ends[:head]
    keep = np.append(ends[1:] != ends[:-1], True)
    return starts[keep], ends[keep]


def _sides(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(s, np.int64), np.asarray(e, np.int64)) for s, e in zip(pdf["starts"], pdf["ends"], strict=True)]


def _joined(pause: int):
    """Two neighbours become their parent."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        first = int(pdf["first"].iloc[0])
        starts, ends = composed(first, *_sides(pdf), pause)
        row = pdf.iloc[[0]].drop(columns=["node"]).rename(columns={"parent": "node"}).copy()
        row["starts"], row["ends"] = [starts.tolist()], [ends.tolist()]
        return row

    return of


def _handed_down(pause: int):
    """The entry of a parent becomes that of its left child, and what the left child makes of it that of the right one."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        before = pdf["_before"].to_numpy().copy()
        before[1:] = after(*_sides(pdf.iloc[[0]])[0], before[:1], pause)
        return pdf.drop(columns=["parent", "first", "starts", "ends"]).assign(_before=before)

    return of


def _entries(summary: DataFrame, keys: Sequence[str], pause: int) -> DataFrame:
    """Per key and segment the time of the last acceptance before it.

    Summaries (keys, segment, first, starts, ends) of neighbours are composed pairwise, level by level, up to one per key;
    the entry of a key is NEVER, and entries come down the same tree.  No group holds more than two summaries; one has at most as many
    steps as there are rows within a pause of its first.
    """
    kinds = dict(summary.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    levels = [durable(summary.withColumnRenamed(SEGMENT, "node").withColumn("node", F.col("node").cast("bigint")))]
    spans = levels[0].groupBy(*keys).agg(F.min("node").alias("a"), F.max("node").alias("b"))
    apart = spans.agg(F.max(F.col("a").bitwiseXOR(F.col("b")))).first()[0] or 0
    pair = Window.partitionBy(*keys, "parent")
    paired = lambda df: df.withColumn("parent", F.shiftright("node", 1)).withColumn("two", F.count("*").over(pair) > 1)
    kept = [*keys, F.col("parent").alias("node"), "first", "starts", "ends"]
    for _ in range(int(apart).bit_length()):
        children = paired(levels[-1])
        both = children.filter("two").drop("two").groupBy(*keys, "parent")
        joined = both.applyInPandas(_joined(pause), head + ", node bigint, first bigint, starts array<bigint>, ends array<bigint>")
        levels.append(durable(children.filter("not two").select(*kept).unionByName(joined)))
    entries = levels.pop().select(*keys, "node", F.lit(NEVER).alias("_before"))
    for level in reversed(levels):
        above = entries.withColumnRenamed("node", "parent")
        children = paired(level).join(above, [*keys, "parent"])
        both = children.filter("two").drop("two").groupBy(*keys, "parent")
        handed = both.applyInPandas(_handed_down(pause), head + ", node bigint, _before bigint")
        entries = durable(children.filter("not two").select(*keys, "node", "_before").unionByName(handed))
    return entries.withColumnRenamed("node", SEGMENT)


def _walk(pause: int, order: list[str]):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        times = pdf["_us"].to_numpy()
        accepted = np.zeros(len(times), dtype=bool)
        i = int(np.searchsorted(times, int(pdf["_before"].iloc[0]) + pause, side="left"))
        while i < len(times):
            accepted[i] = True
            i = int(np.searchsorted(times, times[i] + pause, side="left"))
        return pdf.drop(columns=["_before"]).assign(accepted=accepted)

    return of


def accept_after_cooldown(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], minutes: int = 60, limit: int | None = None
) -> DataFrame:
    """Add ``accepted``: the first row of a key, and each row at least ``minutes`` after the last
    accepted one.

    Where a key is too large for one task, its rows are cut into stretches.  The outcome of a
    stretch depends on the rows before it only through the last accepted time, and that dependence
    is a step function.  So stretches are summarised in parallel, the summaries of neighbours are composed
    in a tree that hands the entries back down, and the stretches are marked in parallel.
    """
    pause = minutes * 60_000_000
    cut = ordered(df.withColumn("_us", micros(F.col(ts), dict(df.dtypes)[ts])), keys, [ts, *tie], limit)
    rows = cut.df.withColumn("_before", F.lit(NEVER))
    if cut.split:
        kinds = dict(cut.df.dtypes)
        head = ", ".join(f"`{k}` {kinds[k]}" for k in cut.parts)
        summary = (
            cut.df.select(*cut.parts, "_us")
            .groupBy(*cut.parts)
            .applyInPandas(_summary(pause), f"{head}, first bigint, starts array<bigint>, ends array<bigint>")
        )
        rows = cut.df.join(_entries(summary, keys, pause), cut.parts)
    out = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes if n != "_before") + ", accepted boolean"
    marked = rows.groupBy(*cut.parts).applyInPandas(_walk(pause, ["_us", *tie]), out)
    return marked.drop("_us", SEGMENT)
