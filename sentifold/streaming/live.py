"""Streams of scores, prices, bars, signals and position changes.

State lives per symbol in Spark's state store and survives a lost executor through the query's
checkpoint, which belongs in the shared folder.  A micro-batch is bounded by the rate limits of the
source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``); rows that a series depends on touch it in the order
(ts, tie-break), whichever batch brings them (``held``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.trading import stop_loss_hit
from ..operators.latest import latest
from ..params import MoodParams, RiskParams
from ..sources.store import merge_newest, read_snapshot, write_snapshot
from .held import Cooled, Moods, in_turn, keep_state_in_rocksdb
from .seen import SPAN_DAYS, first_of_each_time

MOOD_OUT = (
    "symbol string, ts timestamp, tie bigint, total double, ema double, roc double, rows_seen bigint, "
    "z_score double, extreme_value double, is_extreme boolean, late boolean"
)

def live_mood(scores: DataFrame, p: MoodParams = MoodParams(), hold_minutes: int = 0) -> DataFrame:
    """Average, change, z-score and extreme test of each new score (symbol, ts, tie, total).

    The state per symbol is the number of rows seen and the last averages that the statistics look back on.
    Scores wait until the watermark, ``hold_minutes`` behind the newest time of all symbols, has passed them, and are taken in
    the order (ts, tie); what comes behind a score already taken is returned with ``late`` set and leaves the series alone.
    """
    work = Moods(p.alpha, p.stats_rows, p.min_std, p.warmup_rows, p.warmup_limit, p.extreme_std)
    kinds = {"ema": "Float64", "roc": "Float64", "rows_seen": "Int64", "z_score": "Float64", "extreme_value": "Float64", "is_extreme": "boolean"}
    return in_turn(scores, hold_minutes, work, MOOD_OUT, kinds)


def live_cooldown(signals: DataFrame, minutes: int = 60, hold_minutes: int = 0) -> DataFrame:
    """Signals (symbol, ts, tie) that come at least ``minutes`` after the last accepted one.

    Signals wait as scores do in ``live_mood``; those behind a signal already taken are returned with ``late`` set.
    """
    out = "symbol string, ts timestamp, tie bigint, late boolean"
    return in_turn(signals.withColumn("total", F.lit(0.0)), hold_minutes, Cooled(minutes * 60_000_000), out, {})


def replay_bars(
    spark: SparkSession, path: str, schema: str, ts: str = "ts", late: str | None = None, **options
) -> DataFrame:
    """Bars from landed files as a stream, without repeated ones (see ``unique_bars``)."""
    bars = spark.readStream.schema(schema).options(**options).parquet(path)
    return unique_bars(bars, ts, late)


def unique_bars(bars: DataFrame, ts: str = "ts", late: str | None = None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The first of each bar, whenever it comes.

    The state keeps every key (``unique_bars_of_symbols`` keeps them in far less room).  With ``late`` it forgets keys that the watermark has passed, and then bars later than
    that are lost: a choice of the caller.
    """
    if bars.isStreaming:  # the default provider copies the whole state in memory for every micro-batch
        keep_state_in_rocksdb(bars.sparkSession)
    if late is None:
        return bars.dropDuplicates([*keys, ts])
    return bars.withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, ts])


def unique_bars_of_symbols(
    bars: DataFrame, ts: str = "ts", keys: Sequence[str] = ("symbol",), span_days: int = SPAN_DAYS, forget_days: int | None = None
) -> DataFrame:
    """As ``unique_bars`` without a watermark, for long streams: state grows by symbols and spans of days, not by bars (see ``seen``)."""
    return first_of_each_time(bars, keys, ts, span_days, forget_days)


def live_stop_loss(prices: DataFrame, positions: DataFrame, p: RiskParams = RiskParams()) -> DataFrame:
    """Each new price (symbol, ts, price) against the held positions: a stream-static join."""
    held = positions.filter("quantity <> 0").select("symbol", "quantity", "avg_cost")
    joined = prices.join(held, "symbol")
    return joined.filter(stop_loss_hit(F.col("quantity"), F.col("avg_cost"), F.col("price"), p))


def enrich_with_positions(scores: DataFrame, positions: DataFrame) -> DataFrame:
    """New scores with the position held in their symbol, if any."""
    return scores.join(positions, "symbol", "left")


def position_writer(path: str, order: Sequence[str] = ("ts",), keep: int = 3) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that folds position changes (symbol, ..., closed) into snapshots.

    Batch n reads the newest snapshot before n and writes n, so running a batch again gives the same.
    The last ``keep`` snapshots remain.
    A row with ``closed`` set takes its symbol out.
    """

    def write(batch: DataFrame, number: int) -> None:
        changes = latest(batch, ["symbol"], list(order))
        if number > 0:
            before = read_snapshot(batch.sparkSession, path, number)
            changes = merge_newest(before.withColumn("closed", F.lit(False)), changes.select(*before.columns, "closed"), ["symbol"])
        write_snapshot(changes.filter(~F.col("closed")).drop("closed"), path, number, keep)

    return write


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what has arrived and return the rows it wrote."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
