"""Streams over several micro-batches give what one batch gives."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentifold.operators.cooldown import accept_after_cooldown
from sentifold.operators.series import with_ema
from sentifold.sources.store import read_snapshot
from sentifold.streaming import buckets, held, live, seen

T0 = dt.datetime(2024, 1, 1)


def landed(spark, path, rows, schema, files=4):
    """Write rows as consecutive files, one micro-batch each."""
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture
def scores():
    rnd = random.Random(4)
    return [(rnd.choice("abc"), T0 + dt.timedelta(minutes=7 * i), i, rnd.uniform(-5, 5)) for i in range(240)]


SCORES = "symbol string, ts timestamp, tie long, total double"


def test_live_mood_equals_batch(spark, tmp_path, scores):
    stream = landed(spark, f"{tmp_path}/in", scores, SCORES)
    got = {r.tie: r for r in live.drain(live.live_mood(stream), f"{tmp_path}/out", f"{tmp_path}/state").collect()}
    batch = with_ema(spark.createDataFrame(scores, SCORES), ["symbol"], ["ts", "tie"], "total", 0.2).collect()
    assert len(got) == len(batch) == 240
    assert all(got[r.tie].ema == pytest.approx(r.ema) for r in batch)
    assert max(r.rows_seen for r in got.values()) > 30


def test_live_cooldown_equals_batch(spark, tmp_path, scores):
    stream = landed(spark, f"{tmp_path}/in", scores, SCORES)
    got = live.drain(live.live_cooldown(stream, 60), f"{tmp_path}/out", f"{tmp_path}/state")
    want = accept_after_cooldown(spark.createDataFrame(scores, SCORES), ["symbol"], "ts", ["tie"], 60).filter("accepted")
    assert {r.tie for r in got.collect()} == {r.tie for r in want.collect()}


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path, scores):
    schema, path = SCORES, f"{tmp_path}/in"
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    landed(spark, path, scores[:120], schema, 2)
    read = lambda: spark.readStream.schema(schema).parquet(path)
    live.drain(live.live_mood(read()), out, state)
    landed(spark, path, scores[120:], schema, 2)
    got = live.drain(live.live_mood(read()), out, state)
    batch = {r.tie: r.ema for r in with_ema(spark.createDataFrame(scores, schema), ["symbol"], ["ts", "tie"], "total", 0.2).collect()}
    assert {r.tie: round(r.ema, 9) for r in got.collect()} == {k: round(v, 9) for k, v in batch.items()}


def test_position_changes(spark, tmp_path):
    schema = "symbol string, ts timestamp, quantity long, closed boolean"
    t = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", t(0), 1, False), ("b", t(1), 2, False), ("a", t(2), 5, False), ("b", t(3), 0, True), ("c", t(4), 7, False), ("a", t(5), 6, False)]
    stream = landed(spark, f"{tmp_path}/in", rows, schema, 3)
    live.drain_batches(stream, live.position_writer(f"{tmp_path}/positions"), f"{tmp_path}/state")
    assert {(r.symbol, r.quantity) for r in read_snapshot(spark, f"{tmp_path}/positions").collect()} == {("a", 6), ("c", 7)}
    write = live.position_writer(f"{tmp_path}/positions")
    again = spark.createDataFrame(rows[4:], schema)
    write(again, 2)  # a batch that runs twice changes nothing
    assert {(r.symbol, r.quantity) for r in read_snapshot(spark, f"{tmp_path}/positions").collect()} == {("a", 6), ("c", 7)}


def test_all_positions_closed(spark, tmp_path):
    schema = "symbol string, ts timestamp, quantity long, closed boolean"
    rows = [("a", T0, 1, False), ("a", T0 + dt.timedelta(1), 0, True), ("b", T0 + dt.timedelta(2), 4, False)]
    write = live.position_writer(f"{tmp_path}/positions")
    held = []
    for number, row in enumerate(rows):
        write(spark.createDataFrame([row], schema), number)
        held.append([(r.symbol, r.quantity) for r in read_snapshot(spark, f"{tmp_path}/positions").collect()])
    assert held == [[("a", 1)], [], [("b", 4)]]


def test_stop_loss_and_unique_bars(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double"
    t = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", t(0), 94.0), ("a", t(0), 94.0), ("b", t(1), 94.0), ("a", t(2), 99.0)]
    stream = landed(spark, f"{tmp_path}/in", rows, schema, 2)
    held = spark.createDataFrame([("a", 10, 100.0), ("b", -10, 100.0)], "symbol string, quantity long, avg_cost double")
    hits = live.drain(live.live_stop_loss(live.unique_bars(stream), held), f"{tmp_path}/out", f"{tmp_path}/state")
    assert [(r.symbol, r.price) for r in hits.collect()] == [("a", 94.0)]


def test_replay_and_enrich(spark, tmp_path):
    schema = "symbol string, ts timestamp, close double"
    landed(spark, f"{tmp_path}/in", [("a", T0, 1.0), ("a", T0, 1.0), ("b", T0, 2.0)], schema, 1)
    bars = live.replay_bars(spark, f"{tmp_path}/in", schema, maxFilesPerTrigger=1)
    held = spark.createDataFrame([("a", 5)], "symbol string, quantity long")
    got = live.drain(live.enrich_with_positions(bars, held), f"{tmp_path}/out", f"{tmp_path}/state")
    assert {(r.symbol, r.quantity) for r in got.collect()} == {("a", 5), ("b", None)}


def test_rows_out_of_order_wait_and_later_ones_are_told(spark, tmp_path):
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", minute(m), m, float(m)) for m in (0, 30, 10, 60, 5, 200, 300)]
    want = {r.tie: r.ema for r in with_ema(spark.createDataFrame(rows[:4] + rows[5:6], SCORES), ["symbol"], ["ts", "tie"], "total", 0.2).collect()}
    stream = landed(spark, f"{tmp_path}/in", rows, SCORES, files=len(rows))
    out = live.drain(live.live_mood(stream, hold_minutes=40), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    got = {r.tie: r.ema for r in out if not r.late}
    assert got == {k: pytest.approx(want[k]) for k in (0, 10, 30, 60, 200)}
    assert [(r.tie, r.ema) for r in out if r.late] == [(5, None)]
    cooled = live.drain(live.live_cooldown(stream, 25, 40), f"{tmp_path}/out2", f"{tmp_path}/state2").collect()
    assert {(r.tie, r.late) for r in cooled} == {(0, False), (30, False), (60, False), (200, False), (5, True)}


def test_repeated_bars_however_late(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", day(1)), ("a", day(20)), ("a", day(2)), ("a", day(1))]
    stream = landed(spark, f"{tmp_path}/in", rows, "symbol string, ts timestamp", files=4)
    got = live.drain(live.unique_bars(stream), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    assert sorted(r.ts for r in got) == [day(1), day(2), day(20)]


def test_rows_of_a_silent_symbol_come_out(spark, tmp_path):
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", minute(5), 1, 1.0), ("b", minute(3), 2, 2.0), ("a", minute(0), 3, 3.0), ("b", minute(60), 4, 4.0), ("b", minute(61), 5, 5.0), ("a", minute(2), 6, 6.0)]
    stream = landed(spark, f"{tmp_path}/in", rows, SCORES, files=len(rows))
    out = live.drain(live.live_mood(stream, hold_minutes=30), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    assert [(r.tie, r.rows_seen) for r in sorted(out, key=lambda r: r.ts) if r.symbol == "a" and not r.late] == [(3, 1), (1, 2)]
    assert {(r.tie, r.late) for r in out} == {(3, False), (1, False), (2, False), (6, True)}
    cooled = live.drain(live.live_cooldown(stream, 10, 30), f"{tmp_path}/out2", f"{tmp_path}/state2").collect()
    assert {(r.tie, r.late) for r in cooled} == {(3, False), (2, False), (6, True)}


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_within_the_hold_equals_batch(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abcd"), T0 + dt.timedelta(minutes=i, microseconds=rnd.randrange(10**6)), i, rnd.uniform(-5, 5)) for i in range(300)]
    landing = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rnd.uniform(0, 50)))
    stream = landed(spark, f"{tmp_path}/in", landing, SCORES, files=6)
    got = {r.tie: r for r in live.drain(live.live_mood(stream, hold_minutes=55), f"{tmp_path}/out", f"{tmp_path}/state").collect()}
    due = [r for r in rows if r[1] <= max(x[1] for x in rows).replace(microsecond=0) - dt.timedelta(minutes=55)]
    batch = with_ema(spark.createDataFrame(rows, SCORES), ["symbol"], ["ts", "tie"], "total", 0.2).collect()
    want = {r.tie: r.ema for r in batch}
    assert not any(r.late for r in got.values())
    assert {r[2] for r in due} <= set(got)
    assert {k: r.ema for k, r in got.items()} == {k: pytest.approx(want[k]) for k in got}


def test_shuffled_within_the_hold_cooldown(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), T0 + dt.timedelta(minutes=rnd.randrange(600)), i, 0.0) for i in range(200)]
    landing = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rnd.uniform(0, 50)))
    landing += [("z", T0 + dt.timedelta(days=2), 1000, 0.0)]  # time goes on
    stream = landed(spark, f"{tmp_path}/in", landing, SCORES, files=5)
    got = live.drain(live.live_cooldown(stream, 45, 55), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    want = accept_after_cooldown(spark.createDataFrame(rows, SCORES), ["symbol"], "ts", ["tie"], 45).filter("accepted")
    assert {r.tie for r in got} == {r.tie for r in want.collect()}


@given(st.sets(st.integers(-(2**50), 2**50), min_size=1, max_size=40), st.integers(1, 10**9), st.integers(0, 300))
@settings(max_examples=60, deadline=None)
def test_times_as_runs(loose, step, n):
    times = np.array(sorted(loose | {step * i for i in range(n)}), np.int64)
    assert (seen.unpacked(seen.packed(times)) == times).all()


def test_even_times_take_little_room():
    minutes = np.concatenate([d * seen.DAY_US + 60_000_000 * np.arange(240) for d in range(250)])
    assert len(seen.packed(minutes)) < 250 * 40 < len(minutes)


def test_first_of_each_time(spark, tmp_path):
    """Repeats within a file, in the next and in the last; NULLs, NaN, long numbers and microseconds come out whole."""
    schema = "symbol string, ts timestamp, price double, volume long, paid decimal(20,4), day date, `_from here` array<int>"
    rnd = random.Random(8)
    us = lambda k: T0 + dt.timedelta(days=k * 9, microseconds=k % 3)
    values = {}
    for s in ("a", "b", None):
        for k in [*range(90), None]:
            whole = (rnd.choice([None, 0.1, float("inf"), float("nan")]), rnd.choice([None, 2**62 + 1]), rnd.choice([None, Decimal("1234567890123456.7891")]))
            values[s, None if k is None else us(k)] = (s, None if k is None else us(k), *whole, T0.date(), [1, 2])
    rows = list(values.values())
    landed_rows = rnd.sample(rows, 150) + rows + rnd.sample(rows, 150)
    stream = landed(spark, f"{tmp_path}/in", landed_rows, schema, 5)
    got = live.drain(live.unique_bars_of_symbols(stream, span_days=365), f"{tmp_path}/out", f"{tmp_path}/state")
    assert got.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    text = lambda r: (*map(repr, r),)  # noqa: E731  (NaN equals nothing)
    assert sorted(map(text, got.collect())) == sorted(map(text, rows))
    state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "seen").load()
    years = {None if t is None else (t - dt.datetime(1970, 1, 1)).days // 365 for _, t in values}
    assert state.count() == 3 * len(years) < 20  # a row per symbol and span, for 273 bars


def test_state_is_kept_per_bucket(spark, tmp_path):
    """Many symbols are a state row per bucket, and a symbol is the same one in the next batch and after a restart."""
    rnd = random.Random(6)
    rows = [(f"s{rnd.randrange(400)}", T0 + dt.timedelta(minutes=i), i, rnd.uniform(-5, 5)) for i in range(2000)]
    want = {r.tie: r.ema for r in with_ema(spark.createDataFrame(rows, SCORES), ["symbol"], ["ts", "tie"], "total", 0.2).collect()}
    landed(spark, f"{tmp_path}/in", rows[:1200], SCORES, 2)
    read = lambda: spark.readStream.schema(SCORES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.drain(live.live_mood(read()), f"{tmp_path}/out", f"{tmp_path}/state")
    landed(spark, f"{tmp_path}/in", rows[1200:], SCORES, 2)
    got = live.drain(live.live_mood(read()), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    assert {r.tie: r.ema for r in got} == {k: pytest.approx(v) for k, v in want.items()}
    state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "symbols").load()
    assert 0 < state.count() <= buckets.BUCKETS < len({r[0] for r in rows})


def test_seen_bars_are_kept_per_bucket(spark, tmp_path):
    rows = [(f"s{i % 400}", T0 + dt.timedelta(days=i // 800)) for i in range(1600)]
    stream = landed(spark, f"{tmp_path}/in", rows, "symbol string, ts timestamp", 2)
    got = live.drain(live.unique_bars_of_symbols(stream), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    assert sorted((r.symbol, r.ts) for r in got) == sorted(set(rows))
    state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "seen").load()
    assert 0 < state.count() <= buckets.BUCKETS < 400


def test_scores_without_symbol_time_or_tie(spark, tmp_path):
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(None, minute(0), 1, 1.0), ("a", minute(0), 2, 2.0), ("a", None, 3, 3.0), (None, minute(1), 4, 3.0), ("a", minute(1), None, 4.0), ("a", minute(1), 5, None), ("b", minute(9), 6, 0.0)]
    stream = landed(spark, f"{tmp_path}/in", rows, SCORES, files=3)
    out = live.drain(live.live_mood(stream), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    assert {(r.symbol, r.tie, r.rows_seen, r.late) for r in out} == {
        (None, 1, 1, False), (None, 4, 2, False), ("a", 2, 1, False), ("a", 3, None, True), ("a", None, 2, False), ("a", 5, 3, False), ("b", 6, 1, False),
    }
    ema = {r.tie: r.ema for r in out}
    assert (ema[4], ema[None], ema[5]) == (pytest.approx(1.4), pytest.approx(2.4), pytest.approx(2.4))


def test_bars_forgotten_by_the_clock():
    span = seen._Span(None, 1000, 50)
    assert span.add(np.array(["a", "b", "a"], object), np.array([5, 5, 5])).tolist() == [0, 1]
    span = seen._Span((span.stored(),), 1049, 50)
    assert span.add(np.array(["a", None], object), np.array([6, 6])).tolist() == [0, 1]
    span = seen._Span((span.stored(),), 1050, 50)  # nothing of b was added for 50 ms
    assert span.add(np.array(["b", "a", None, "a"], object), np.array([5, 5, 6, 6])).tolist() == [0]


def test_state_of_unique_bars_is_not_copied_in_memory(spark, tmp_path):
    spark.conf.unset(held.PROVIDER)
    stream = landed(spark, f"{tmp_path}/in", [("a", T0), ("a", T0)], "symbol string, ts timestamp", 2)
    assert live.drain(live.unique_bars(stream), f"{tmp_path}/out", f"{tmp_path}/state").count() == 1
    assert spark.conf.get(held.PROVIDER) == held.ROCKSDB
