"""Operators against plain loops, with keys both below and above the size of a task."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentifold.operators import ledger, median, segments
from sentifold.operators.asof import asof_join
from sentifold.operators.blend import composite, total_score
from sentifold.operators.cooldown import NEVER, _chain_ends, _handed_down, _joined, _summary, _walk, accept_after_cooldown
from sentifold.operators.latest import newest_rows
from sentifold.operators.median import exact_medians
from sentifold.operators.series import (
    cut_after_breach,
    with_confirmation,
    with_drawdown,
    with_ema,
    with_extreme,
    with_prior_zscore,
    with_return_zscore,
    with_trend,
)
from sentifold.params import SOURCE_WEIGHTS, MoodParams
from sentifold.plans.mood import follow, mood_by_observation

LIMITS = pytest.mark.parametrize("limit", [None, 50], ids=["whole", "split"])


def fills(seed=3, hot=600):
    rnd = random.Random(seed)
    rows = [(s, i) for s in "abc" for i in range(80)] + [("hot", i) for i in range(hot)]
    return [
        (s, i, rnd.choice([-1, 1]) * rnd.randint(1, 50), rnd.randint(500, 1500) / 100, rnd.choice(["BUY", "SELL"]))
        for s, i in rows
    ]


FILL_SCHEMA = "symbol string, n int, qty long, price double, side string"


def book_by_loop(rows):
    out = {}
    for s, _, dq, p, _ in rows:
        q, c, all_, open_ = out.get(s, (0, 0.0, 0.0, 0.0))
        if q == 0:
            q, c, open_ = dq, p, 0.0
        elif q * dq > 0:
            c = (abs(q) * c + abs(dq) * p) / (abs(q) + abs(dq))
            q += dq
        else:
            gain = (p - c) * min(abs(q), abs(dq)) * (1 if q > 0 else -1)
            all_, open_ = all_ + gain, open_ + gain
            if abs(dq) > abs(q):
                c = p
            q += dq
            if q == 0:
                open_ = 0.0
        out[s] = (q, c, all_, open_)
    return out


@LIMITS
@pytest.mark.parametrize("fold", [8192, 7])
def test_average_cost_book(spark, limit, fold):
    rows = fills()
    got = ledger.average_cost_book(spark.createDataFrame(rows, FILL_SCHEMA), ["symbol"], ["n"], limit=limit, fold=fold)
    want = book_by_loop(rows)
    for r in got.collect():
        q, c, all_, open_ = want[r.symbol]
        assert r.quantity == q
        assert r.realised_all == pytest.approx(all_)
        assert r.realised_open == pytest.approx(open_)
        if q:
            assert r.avg_cost == pytest.approx(c)


@LIMITS
@pytest.mark.parametrize("stretch", [10**6, 13, 5])
def test_cost_ledger(spark, limit, stretch):
    rows = fills()
    got = ledger.cost_ledger(spark.createDataFrame(rows, FILL_SCHEMA), ["symbol"], ["n"], limit=limit, stretch=stretch).collect()
    got = {(r.symbol, r.n): r for r in got}
    assert len(got) == len(rows)
    by_symbol = {}
    for row in rows:
        s, n, dq, p, _ = row
        q, c, total = by_symbol.get(s, (0, 0.0, 0.0))
        gain = 0.0
        if q == 0:
            q, c = dq, p
        elif q * dq > 0:
            c = (abs(q) * c + abs(dq) * p) / (abs(q) + abs(dq))
            q += dq
        else:
            gain = (p - c) * min(abs(q), abs(dq)) * (1 if q > 0 else -1)
            c = p if abs(dq) > abs(q) else c
            q += dq
        by_symbol[s] = (q, c, total + gain)
        r = got[s, n]
        assert r.quantity_after == q
        assert r.realised == pytest.approx(gain, abs=1e-7)
        assert r.avg_cost_after == (pytest.approx(c) if q else None)


def test_average_cost_known(spark):
    rows = [("x", 0, 100, 10.0, ""), ("x", 1, 100, 12.0, ""), ("x", 2, -150, 13.0, ""), ("x", 3, -100, 9.0, "")]
    want = [(100, 10.0, 0.0), (200, 11.0, 0.0), (50, 11.0, 300.0), (-50, 9.0, 200.0)]
    for k, (q, c, profit) in enumerate(want):
        r = ledger.average_cost_book(spark.createDataFrame(rows[: k + 1], FILL_SCHEMA), ["symbol"], ["n"]).first()
        assert (r.quantity, r.avg_cost, r.realised_all) == (q, pytest.approx(c), pytest.approx(profit))


@LIMITS
def test_fifo_pairs(spark, limit):
    rows = fills()
    want, queues, number = set(), {}, {}
    for s, i, _, _, side in rows:
        queue = queues.setdefault(s, [])
        if side == "BUY":
            queue.append(i)
        elif queue:
            number[s] = number.get(s, 0) + 1
            want.add((s, number[s], queue.pop(0), i))
    got = ledger.fifo_pairs(spark.createDataFrame(rows, FILL_SCHEMA), ["symbol"], ["n"], ["n"], limit)
    assert {(r.symbol, r.pair_no, r.buy_n, r.sell_n) for r in got.collect()} == want


def test_fifo_known(spark):
    sides = ["BUY", "BUY", "SELL", "SELL", "SELL", "BUY", "SELL"]
    df = spark.createDataFrame([("x", i, 1, 1.0, s) for i, s in enumerate(sides)], FILL_SCHEMA)
    got = ledger.fifo_pairs(df, ["symbol"], ["n"], ["n"]).collect()
    assert {(r.buy_n, r.sell_n) for r in got} == {(0, 2), (1, 3), (5, 6)}


@LIMITS
def test_running_and_positions(spark, limit):
    rows = fills()
    df = spark.createDataFrame(rows, FILL_SCHEMA)
    cut = segments.ordered(df, ["symbol"], ["n"], limit)
    assert cut.split == (limit is not None)
    out = segments.positions(
        segments.running(
            cut,
            {
                "s": ("sum", F.col("qty")),
                "lo": ("min", F.col("price")),
                "hi": ("max", F.col("price")),
                "seen": ("last", F.when(F.col("n") % 7 == 0, F.col("n"))),
            },
        )
    ).rows()
    want, state = {}, {}
    for s, i, q, p, _ in rows:
        total, lo, hi, seen = state.get(s, (0, 1e9, -1e9, None))
        state[s] = (total + q, min(lo, p), max(hi, p), i if i % 7 == 0 else seen)
        want[s, i] = state[s]
    got = {(r.symbol, r.n): (r.s, r.lo, r.hi, r.seen) for r in out.collect()}
    assert got == want
    assert all(r.pos == r.n for r in out.collect())


def test_hot_key_is_spread(spark):
    cut = segments.ordered(spark.createDataFrame(fills(hot=4000), FILL_SCHEMA), ["symbol"], ["n"], 100)
    sizes = cut.df.groupBy("symbol", segments.SEGMENT).count().collect()
    assert max(r["count"] for r in sizes) < 2000
    assert len([r for r in sizes if r.symbol == "hot"]) >= 4


@LIMITS
def test_exact_medians(spark, limit):
    rnd = random.Random(5)
    rows = [(k, rnd.randint(0, 400) / 4, rnd.choice([None, 1.0, 2.0, 7.5])) for k in "ab" for _ in range(301 if k == "a" else 88)]
    got = {r.k: (r.x, r.y) for r in exact_medians(spark.createDataFrame(rows, "k string, x double, y double"), "k", ["x", "y"], limit).collect()}

    def median(values):
        v = sorted(x for x in values if x is not None)
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2

    assert got == {k: (median(r[1] for r in rows if r[0] == k), median(r[2] for r in rows if r[0] == k)) for k in "ab"}


@pytest.mark.parametrize("accuracy, margin", [(10_000, 5), (200, 4), (3, 0)], ids=["fine", "coarse", "missing"])
def test_bracketed_medians(spark, accuracy, margin):
    """A hot group, ties, a NULL key, NaN, an empty column; the last bracket holds hardly any middle and is proved wrong."""
    rnd = random.Random(9)
    rows = [("hot", rnd.gauss(0, 1e3), 4.0) for _ in range(6001)] + [("even", float(i), float(i % 3)) for i in range(800)]
    rows += [(None, float(i * i), None) for i in range(501)] + [("nan", x, None) for x in (1.0, float("nan"), 2.0)] + [("none", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(7)
    got = {r.k: (r.x, r.y) for r in exact_medians(df, "k", ["x", "y"], 400, accuracy, margin).collect()}
    hot = sorted(r[1] for r in rows if r[0] == "hot")
    assert got == {"hot": (hot[3000], 4.0), "even": (399.5, 1.0), None: (62500.0, None), "nan": (2.0, None)}


def test_medians_order_the_bracket_only(spark):
    df = spark.range(50_000).select(F.lit("hot").alias("k"), F.rand(3).alias("x"))
    inside = median._bracketed(df.select("k", F.lit("x").alias("_name"), F.col("x").alias("_v")), ["k", "_name"], 10_000, 5)
    sizes = {r["_side"]: r["n"] for r in median._counted(inside, ["k", "_name"]).groupBy("_side").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes[-1] == sizes[1] == 1 and 1 < sizes[0] < 200


@LIMITS
def test_asof(spark, limit):
    left = [("a", i * 10, i) for i in range(1, 40)] + [("b", 5, 0)]
    right = [("a", 15, 1.0), ("a", 20, 2.0), ("a", 300, 3.0)]
    got = asof_join(
        spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, t int, v double"),
        ["k"], "t", "v", ["id"], True, limit and 10,
    )
    want = {(k, t): max(((rt, v) for rk, rt, v in right if rk == k and rt <= t), default=(0, None))[1] for k, t, _ in left}
    assert {(r.k, r.t): r.v for r in got.collect()} == want


@LIMITS
def test_cooldown(spark, limit):
    rnd = random.Random(2)
    rows, want = [], set()
    for k, n, step in (("a", 60, 50), ("hot", 500, 9), ("z", 1, 1)):
        t, last = 0, None
        for i in range(n):
            t += rnd.randint(0, step)
            rows.append((k, t, i))
            if last is None or t >= last + 60:
                want.add((k, i))
                last = t
    df = spark.createDataFrame(rows, "k string, m int, id int").withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, m)")
    )
    got = accept_after_cooldown(df, ["k"], "ts", ["id"], 60, limit).filter("accepted").collect()
    assert {(r.k, r.id) for r in got} == want


def test_cooldown_with_a_pause_over_several_segments(spark):
    """A pause of 60 minutes holds hundreds of rows, a segment 20."""
    rnd = random.Random(6)
    rows = [("hot", rnd.randrange(240 * 60), i) for i in range(1500)] + [("a", 5, 0), ("a", 7, 1)]
    df = spark.createDataFrame(rows, "k string, s int, id int").withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)"))
    got = accept_after_cooldown(df, ["k"], "ts", ["id"], 60, 20).filter("accepted").collect()
    want, last = set(), {}
    for k, t, i in sorted(rows):
        if k not in last or t >= last[k] + 3600:
            want.add((k, i))
            last[k] = t
    assert {(r.k, r.id) for r in got} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=60), st.integers(1, 40), st.integers(1, 9))
def test_cooldown_stretches_agree_with_walk(times, pause, cuts):
    """Summaries of any cut, composed in a tree and entries handed down, mark the same rows as one plain walk."""
    import pandas as pd

    times = sorted(times)
    want, last = [], None
    for t in times:
        ok = last is None or t >= last + pause
        want.append(ok)
        last = t if ok else last
    size = -(-len(times) // cuts)
    parts = [times[i : i + size] for i in range(0, len(times), size)]
    frames = [pd.DataFrame({"k": "a", "segment": i, "_us": p}) for i, p in enumerate(parts)]
    levels = [[_summary(pause)(f).rename(columns={"segment": "node"}) for f in frames]]
    family = lambda level, i: pd.concat(level[i : i + 2]).assign(parent=i // 2)
    while len(levels[-1]) > 1:
        level = levels[-1]
        pairs = [family(level, i) for i in range(0, len(level), 2)]
        levels.append([_joined(pause)(p) if len(p) == 2 else p.drop(columns="node").rename(columns={"parent": "node"}) for p in pairs])
    entries = [NEVER]
    for level in reversed(levels[:-1]):
        pairs = [family(level, i).assign(_before=entries[i // 2]) for i in range(0, len(level), 2)]
        entries = [e for p in pairs for e in (_handed_down(pause)(p)["_before"] if len(p) == 2 else p["_before"])]
    got = []
    for f, before in zip(frames, entries, strict=True):
        got += _walk(pause, ["_us"])(f.assign(_before=before))["accepted"].tolist()
    assert got == want
    assert len(_chain_ends(frames[0]["_us"].to_numpy(), pause)) == len(parts[0])


@pytest.mark.parametrize("alpha", [0.2, 0.05, 0.9, 1.0])
def test_ema_is_the_recursion(spark, alpha):
    rnd = random.Random(9)
    values = [rnd.uniform(-5, 5) for _ in range(4000)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, n int, v double")
    got = [r.ema for r in with_ema(df, ["k"], ["n"], "v", alpha).orderBy("n").collect()]
    e, worst = values[0], 0.0
    for v, g in zip(values[1:], got[1:], strict=True):
        e = alpha * v + (1 - alpha) * e
        worst = max(worst, abs(e - g))
    assert got[0] == values[0] and worst < 1e-11


@pytest.mark.parametrize("alpha", [0.2, 0.9])
@pytest.mark.parametrize("limit", [None, 300], ids=["whole", "split"])
def test_series_in_stretches(spark, limit, alpha):
    """Cut or not, a key has the very same numbers: nothing restarts at a cut."""
    rnd = random.Random(1)
    p = MoodParams(alpha=alpha)
    rows = [(k, i, rnd.uniform(-5, 5)) for k, n in (("hot", 3000), ("a", 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, n int, total double")
    got = {(r.symbol, r.n): r for r in mood_by_observation(df, ["n"], p, limit).collect()}
    want = {(r.symbol, r.n): r for r in follow(df, ["symbol"], ["n"], p).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k].asDict() == w.asDict()


def test_ema_forgets_nothing_at_a_cut(spark):
    """A slow average over a key of many cuts still shows its first value, as the recursion does; a NULL key too."""
    alpha, n = 0.002, 4000
    for k in ("hot", None):
        df = spark.createDataFrame([(k, i, 1e9 if i == 0 else 0.0) for i in range(n)], "symbol string, n int, total double")
        numbered = df.withColumn("at", F.col("n").cast("bigint"))
        got = [r.ema for r in with_ema(numbered, ["symbol"], ["n"], "total", alpha, position="at").orderBy("n").collect()]
        assert got == pytest.approx([1e9 * (1 - alpha) ** i for i in range(n)], rel=1e-9)
    fast = [(k, i, 1e9 if i == 0 else 0.0) for k in ("hot", None) for i in range(1000)]
    df = spark.createDataFrame(fast, "symbol string, at bigint, total double")
    for r in with_ema(df, ["symbol"], ["at"], "total", 0.5, position="at").filter("at < 800").collect():
        assert r.ema == pytest.approx(1e9 * 0.5**r["at"], rel=1e-9)  # blocks of 432 rows


def test_ema_known(spark):
    df = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 3.0)], "k string, n int, v double")
    assert [r.ema for r in with_ema(df, ["k"], ["n"], "v", 0.2).orderBy("n").collect()] == pytest.approx([2.0, 2.2])


def test_composite_known(spark):
    rows = [("600519", 1, "news", 0.6, 0.8), ("600519", 1, "social", 0.4, 0.7), ("600519", 2, "news", -1.0, 0.1),
            ("600519", 1, "other", 1.0, 1.0), ("x", 1, "other", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts int, source string, score double, confidence double")
    (r,) = composite(df, ["symbol"], ["ts"], SOURCE_WEIGHTS).collect()
    assert r.score == pytest.approx(0.506667, abs=1e-6)
    assert r.confidence == pytest.approx(0.75)
    assert r.n_sources == 2 and r.source_scores == {"news": 0.6, "social": 0.4}


def test_total_score_known(spark):
    rows = [("a", 1, s, v, c) for s, v, c in (("news", -0.4, 0.8), ("social", -0.6, 0.7), ("search", -0.7, 0.6), ("forum", -0.5, 0.5))]
    rows += [("b", 1, "blog", 1.0, 0.4)]
    df = spark.createDataFrame(rows, "symbol string, ts int, source string, score double, confidence double")
    got = {r.symbol: r for r in total_score(df, ["symbol"], ["ts"]).collect()}
    assert got["a"].total == pytest.approx(-2.625)
    assert got["a"].mean_confidence == pytest.approx(0.65)
    assert got["a"].source_scores["search"] == pytest.approx(-0.7 * 0.15 * 5)
    assert got["b"].total == 0.0 and got["b"].source_scores == {"blog": 0.0}


def test_cold_start_extreme(spark):
    df = spark.createDataFrame([("a", 0, -2.625)], "k string, n int, ema double")
    r = with_extreme(with_prior_zscore(df, ["k"], ["n"], "ema"), ["k"], ["n"]).first()
    assert r.is_extreme and r.extreme_value == 2.625 and r.z_score == 0.0


def test_low_variance_zscore(spark):
    df = spark.createDataFrame([("a", i, 1.0 + (i == 11) * 5) for i in range(12)], "k string, n int, ema double")
    rows = with_prior_zscore(df, ["k"], ["n"], "ema").orderBy("n").collect()
    assert all(r.z_score == 0.0 for r in rows)


def test_drawdown_and_stop(spark):
    curve = [100.0, 110.0, 99.0, 88.0, 120.0, 60.0]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(curve)], "k string, n int, equity double")
    down = with_drawdown(df, ["k"], ["n"], "equity", 105.0)
    assert [round(r.drawdown, 6) for r in down.orderBy("n").collect()] == [
        round(x, 6) for x in (5 / 105, 0, 0.1, 0.2, 0, 0.5)
    ]
    assert cut_after_breach(down, ["k"], ["n"], 0.2).count() == 4


def test_trend_and_confirmation(spark):
    df = spark.createDataFrame([("a", i, v, t) for i, (v, t) in enumerate([(1.0, "BUY"), (2.0, "BUY"), (4.0, "SELL"), (3.0, "SELL")])],
                               "k string, n int, v double, signal_type string")
    assert [r.trend for r in with_trend(df, ["k"], ["n"], "v").orderBy("n").collect()] == [None, None, 2.0, -1.0]
    assert [r.confirmed for r in with_confirmation(df, ["k"], ["n"]).orderBy("n").collect()] == [False, True, False, True]


def test_newest_rows(spark):
    df = spark.createDataFrame([(k, i) for k in "ab" for i in range(9)], "k string, n int")
    assert {(r.k, r.n) for r in newest_rows(df, ["k"], ["n"], 2).collect()} == {("a", 7), ("a", 8), ("b", 7), ("b", 8)}


@pytest.mark.parametrize("lookback", [5, 30, 252])
def test_return_zscores_of_tiny_returns(spark, lookback):
    """Closes near 1e9 with gaps between days, equal closes, a short key and a missing close, against two passes."""
    import numpy as np

    rnd, rows = random.Random(lookback), []
    for k, n in (("a", 400), ("b", 3), ("flat", 60)):
        day = 18_000
        for _ in range(n):
            day += rnd.choice([1, 1, 1, 3, 40 if rnd.random() < 0.05 else 1])
            rows.append((k, day, 5.0 if k == "flat" else 1e9 + rnd.uniform(-1, 1)))
    rows += [("gap", 18_000 + i, None if i == 30 else 100.0 + rnd.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, d int, close double").withColumn("day", F.expr("date_add(date'1970-01-01', d)"))
    got = {(r.k, r.d): r.z_score for r in with_return_zscore(df, ["k"], lookback_days=lookback, min_rows=4).collect()}
    for k in ("a", "b", "flat", "gap"):
        own = [(d, c) for q, d, c in rows if q == k]
        returns = [None] + [None if x is None or y is None else y / x - 1 for (_, x), (_, y) in zip(own[:-1], own[1:])]
        for i, (d, _) in enumerate(own):
            frame = [r for (e, _), r in zip(own, returns) if d - lookback <= e <= d]
            used = np.array([r for r in frame[1:] if r is not None])
            want = None
            if len(used) >= 4 and np.ptp(used) > 0 and returns[i] is not None:
                want = (returns[i] - used.mean()) / used.std(ddof=1)
            assert got[k, d] == (None if want is None else pytest.approx(want, rel=1e-6, abs=1e-6))


def test_weighted_zscores_far_from_zero(spark):
    from sentifold.plans.rules import zscore_modes

    rnd, alpha = random.Random(3), 2 / 21
    values = [1e9 + rnd.uniform(-1e-3, 1e-3) for _ in range(300)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "symbol string, day int, v double")
    got = [r.z_score for r in zscore_modes(df, "v", "ewma").orderBy("day").collect()]
    weight, seen = [1.0], [0.0]
    for i, v in enumerate(values[1:], 1):
        weight = [w * (1 - alpha) for w in weight] + [alpha]
        seen.append(v - values[0])
        mean = sum(w * x for w, x in zip(weight, seen))
        var = sum(w * (x - mean) ** 2 for w, x in zip(weight, seen))
        assert got[i] == pytest.approx((seen[-1] - mean) / var**0.5, rel=1e-3)


def test_partitions_follow_what_a_task_holds(spark):
    """A low limit spreads keys; it does not multiply tasks and samples."""
    cut = segments.ordered(spark.createDataFrame(fills(hot=4000), FILL_SCHEMA), ["symbol"], ["n"], 10)
    assert cut.split and cut.df.select(segments.SEGMENT).distinct().count() <= 8
