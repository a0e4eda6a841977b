"""Rows that wait for older ones: per symbol they are taken in the order (ts, tie) once the watermark has passed them.

The watermark is the newest time of the whole stream less the hold, so rows of a symbol that falls silent come out as soon as any
other symbol goes on.  State, in RocksDB, is kept per bucket of symbols (see ``buckets``): a list of tables of the rows that wait, and a table of
the symbols with the place of the last row taken and what the work remembers.  One timer per bucket stands at the earliest row that waits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .buckets import BUCKETS, from_bytes, in_buckets, to_bytes

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Before all times and ties; a NULL tie counts as it.
NEVER = np.iinfo(np.int64).min

# Rows whose statistics are worked out at once.
ROWS_AT_ONCE = 65_536

# A number or several per symbol, by name.
Memory = dict[str, np.ndarray]


class Work(Protocol):
    """What is done to rows in their turn."""

    def nothing(self, n: int) -> Memory:
        """What it remembers of ``n`` symbols without rows."""

    def take(self, rows: pd.DataFrame, starts: np.ndarray, who: np.ndarray, memory: Memory) -> pd.DataFrame:
        """The columns it makes of rows (any subset) in their turn: those of symbol ``who[i]`` begin at ``starts[i]``.  Brings ``memory`` up to date."""


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Lists and timers need it; a session that names a provider of its own keeps that."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(PROVIDER, "HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


def _last_us(timers) -> int:
    """The last microsecond that the watermark, which counts in milliseconds, has reached."""
    return timers.getCurrentWatermarkInMs() * 1000 + 999


def _column(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers) if numbers.ndim == 1 else pa.FixedSizeListArray.from_arrays(pa.array(numbers.ravel()), numbers.shape[1])


def _numbers(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.FixedSizeListArray):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).copy()
    return column.to_numpy(zero_copy_only=False).copy()


class _Symbols:
    """The symbols of a bucket, each with its place, the last row taken and what the work remembers; a place never changes."""

    def __init__(self, work: Work, stored: bytes | None):
        self.work, self.names, self.changed = work, np.empty(0, object), False
        self.last_us = self.last_tie = np.empty(0, np.int64)
        self.memory = work.nothing(0)
        if stored is not None:
            table = from_bytes([stored])
            columns = {name: table.column(name).chunk(0) for name in table.column_names if table.num_rows}
            self.names = columns.pop("symbol").to_numpy(zero_copy_only=False)
            self.last_us, self.last_tie = _numbers(columns.pop("last_us")), _numbers(columns.pop("last_tie"))
            self.memory = {name: _numbers(column) for name, column in columns.items()}

    def places(self, names: np.ndarray) -> np.ndarray:
        """Where the symbols of new rows are; those not met before are added."""
        codes, found = pd.factorize(np.concatenate([self.names, names]), use_na_sentinel=False)
        n, known = len(found) - len(self.names), len(self.names)
        if n:
            self.names = np.append(self.names, found[known:])
            self.last_us, self.last_tie = (np.append(x, np.full(n, NEVER)) for x in (self.last_us, self.last_tie))
            self.memory = {name: np.concatenate([x, more]) for (name, x), more in zip(self.memory.items(), self.work.nothing(n).values(), strict=True)}
            self.changed = True
        return codes[known:]

    def behind(self, rows: pd.DataFrame) -> np.ndarray:
        """Which rows do not come after the last one taken of their symbol."""
        us, tie = self.last_us[rows["at"]], self.last_tie[rows["at"]]
        return ((rows["us"] < us) | ((rows["us"] == us) & (rows["tie"] <= tie))).to_numpy() & (us != NEVER)

    def taken(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows in their turn, worked on."""
        at = rows["at"].to_numpy()
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        who, ends = at[starts], np.append(starts[1:], len(at)) - 1
        made = self.work.take(rows, starts, who, self.memory)
        self.last_us[who], self.last_tie[who] = rows["us"].to_numpy()[ends], rows["tie"].to_numpy()[ends]
        self.changed = True
        return made

    def stored(self) -> bytes:
        columns = {"symbol": pa.array(self.names, pa.string(), from_pandas=True), "last_us": _column(self.last_us), "last_tie": _column(self.last_tie)}
        return to_bytes(pa.table(columns | {name: _column(x) for name, x in self.memory.items()}))


class InTurn(StatefulProcessor):
    """``work`` on each symbol's rows (us, tie, total) in their turn; rows behind the last one taken, or without a time, come out as late."""

    def __init__(self, work: Work, columns: list[str], kinds: dict[str, str]):
        self.work, self.columns, self.kinds = work, columns, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.earliest = handle.getValueState("earliest", "us bigint")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.symbols = handle.getValueState("symbols", "rows binary")

    def _out(self, names: np.ndarray, rows: pd.DataFrame, made: pd.DataFrame | None) -> pd.DataFrame:
        """Rows of the result; without ``made`` they are late."""
        tie = rows["tie"].astype("Int64").mask(rows["tie"] == NEVER)
        out = pd.DataFrame({"symbol": names[rows["at"]], "ts": pd.to_datetime(rows["us"].mask(rows["us"] == NEVER), unit="us"), "tie": tie, "total": rows["total"], "late": made is None})
        for name, kind in self.kinds.items():
            out[name] = pd.array([None] * len(rows) if made is None else made[name], dtype=kind)
        return out[self.columns].reset_index(drop=True)

    def _step(self, upto: int, new: pa.Table | None) -> Iterator[pd.DataFrame]:
        """Takes what is due of the rows that wait, then what is due of new rows; the others wait."""
        earliest = self.earliest.get()
        earliest = None if earliest is None else earliest[0]
        due = earliest is not None and earliest <= upto
        if new is None and not due:
            return
        stored = self.symbols.get()
        symbols = _Symbols(self.work, None if stored is None else stored[0])
        wait = []
        if due:
            rows = from_bytes([bytes(x[0]) for x in self.waiting.get()]).to_pandas()
            wait.append(rows[rows["us"] > upto])
            yield from self._taken(symbols, rows[rows["us"] <= upto])
        if new is not None:
            numbers = {name: new.column(name).fill_null(NEVER).to_numpy() for name in ("us", "tie")}
            rows = pd.DataFrame({"at": symbols.places(new.column("symbol").to_numpy()), **numbers, "total": new.column("total").to_numpy()})
            late = symbols.behind(rows) | (rows["us"] == NEVER).to_numpy()
            if late.any():
                yield self._out(symbols.names, rows[late], None)
            rows = rows[~late]
            wait.append(rows[rows["us"] > upto])
            yield from self._taken(symbols, rows[rows["us"] <= upto])
        rest = pd.concat(wait)
        if len(rest):
            part = [(to_bytes(pa.table({name: rest[name].to_numpy() for name in ("at", "us", "tie", "total")})),)]
            self.waiting.put(part) if due else self.waiting.appendList(part)
        elif due:
            self.waiting.clear()
        if symbols.changed:
            self.symbols.update((symbols.stored(),))
        self._wake(earliest, due, int(rest["us"].min()) if len(rest) else None)

    def _taken(self, symbols: _Symbols, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(rows):
            rows = rows.sort_values(["at", "us", "tie"], kind="stable", ignore_index=True)
            made = symbols.taken(rows)
            if len(made):
                yield self._out(symbols.names, rows.loc[made.index], made)

    def _wake(self, was: int | None, due: bool, least: int | None) -> None:
        """The timer stands at the earliest row that waits."""
        now = least if due or was is None else was if least is None else min(was, least)
        if now == was:
            return
        if was is not None:
            self.handle.deleteTimer(was // 1000)
        if now is None:
            self.earliest.clear()
        else:
            self.earliest.update((now,))
            self.handle.registerTimer(now // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._step(_last_us(timerValues), from_bytes([bytes(part) for frame in rows for part in frame["rows"]]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._step(_last_us(timerValues), None)

    def close(self) -> None:
        pass


def in_turn(rows: DataFrame, hold_minutes: int, work: Work, schema: str, kinds: dict[str, str], buckets: int = BUCKETS) -> DataFrame:
    """Rows (symbol, ts, tie, total) through ``work``; ``kinds`` are the pandas types of the columns it makes."""
    keep_state_in_rocksdb(rows.sparkSession)
    marked = rows.withWatermark("ts", f"{hold_minutes} minutes")
    # A column of its own, without the watermark's mark: rows behind the watermark are told, not dropped.
    marked = marked.select("symbol", F.unix_micros("ts").alias("us"), F.col("tie").cast("bigint").alias("tie"), F.col("total").cast("double").alias("total"))
    columns = [part.split()[0] for part in schema.split(", ")]
    return in_buckets(marked, F.col("symbol"), buckets).transformWithStateInPandas(InTurn(work, columns, kinds), schema, "append", "eventtime")


class Moods:
    """Average, change, z-score and extreme test; remembers the rows seen and the last averages."""

    def __init__(self, alpha: float, stats_rows: int, min_std: float, warmup_rows: int, warmup_limit: float, extreme_std: float):
        self.alpha, self.stats_rows, self.min_std = alpha, stats_rows, min_std
        self.warmup_rows, self.warmup_limit, self.extreme_std = warmup_rows, warmup_limit, extreme_std

    def nothing(self, n: int) -> Memory:
        return {"seen": np.zeros(n, np.int64), "tail": np.full((n, self.stats_rows), np.nan)}

    def _averages(self, totals: list[float], average: float) -> list[float]:
        """The moving average after each row, as pandas has it: a row without a total keeps the average and halves its weight likewise."""
        alpha, keep, weight, out = self.alpha, 1 - self.alpha, 1.0, []
        for x in totals:
            if average == average:
                weight *= keep
                if x == x:
                    if average != x:
                        average = (weight * average + alpha * x) / (weight + alpha)
                    weight = 1.0
            else:
                average = x
            out.append(average)
        return out

    def _statistics(self, past: np.ndarray, ema: np.ndarray) -> np.ndarray:
        """Z-scores against the averages before."""
        have = ~np.isnan(past)
        n = np.maximum(have.sum(axis=1), 1)
        mean = np.where(have, past, 0).sum(axis=1) / n
        std = np.sqrt(np.where(have, past - mean[:, None], 0) ** 2 @ np.ones(past.shape[1]) / n)
        return np.where(std >= self.min_std, (ema - mean) / np.where(std >= self.min_std, std, 1), 0.0)

    def take(self, rows: pd.DataFrame, starts: np.ndarray, who: np.ndarray, memory: Memory) -> pd.DataFrame:
        totals, width = rows["total"].tolist(), self.stats_rows
        counts = np.diff(starts, append=len(rows))
        last = memory["tail"][who, -1]
        ema = np.array([x for a, n, y in zip(starts.tolist(), counts.tolist(), last.tolist(), strict=True) for x in self._averages(totals[a : a + n], y)])
        # Each symbol's remembered averages, then its new ones.
        place = np.arange(len(rows)) + width * np.repeat(np.arange(1, len(who) + 1), counts)
        line = np.empty(len(rows) + width * len(who))
        line[place] = ema
        heads = starts + width * np.arange(len(who))
        line[heads[:, None] + np.arange(width)] = memory["tail"][who]
        before, back = line[place - 1], width - 1
        windows = np.lib.stride_tricks.sliding_window_view(line, back)
        z = [self._statistics(windows[place[a : a + ROWS_AT_ONCE] - back], ema[a : a + ROWS_AT_ONCE]) for a in range(0, len(rows), ROWS_AT_ONCE)]
        z = np.concatenate(z)
        number = np.repeat(memory["seen"][who] - starts, counts) + np.arange(1, len(rows) + 1)
        warm = number < self.warmup_rows
        size = np.where(warm, np.abs(ema), np.abs(z))
        memory["seen"][who] += counts
        memory["tail"][who] = line[(heads + counts)[:, None] + np.arange(width)]
        return pd.DataFrame({
            "ema": ema, "roc": np.where(np.isnan(before), 0.0, ema - before), "rows_seen": number, "z_score": z,
            "extreme_value": size, "is_extreme": size >= np.where(warm, self.warmup_limit, self.extreme_std),
        }, index=rows.index)


class Cooled:
    """The rows at least ``pause`` microseconds after the last accepted one; remembers that one."""

    def __init__(self, pause: int):
        self.pause = pause

    def nothing(self, n: int) -> Memory:
        return {"last": np.full(n, NEVER)}

    def take(self, rows: pd.DataFrame, starts: np.ndarray, who: np.ndarray, memory: Memory) -> pd.DataFrame:
        times, ends, taken = rows["us"].tolist(), np.append(starts[1:], len(rows)), []
        for i, end, symbol in zip(starts.tolist(), ends.tolist(), who.tolist(), strict=True):
            last = int(memory["last"][symbol])
            i = i if last == NEVER else bisect_left(times, last + self.pause, i, end)
            while i < end:  # a step per accepted row
                taken.append(i)
                last = times[i]
                i = bisect_left(times, last + self.pause, i, end)
            memory["last"][symbol] = last
        return pd.DataFrame(index=rows.index[taken])
