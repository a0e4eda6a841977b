"""Whole jobs on small tables worked by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sentifold.params import ContrarianParams, CostParams, RiskParams, RouterParams
from sentifold.plans import contrarian, orders, performance, routing, strategies, valuation
from sentifold.sources.schemas import SIGNALS, conform

NOW = dt.datetime(2024, 1, 15, 14, 30, 22)


def signals(spark, rows):
    """(symbol, type, source, strength, confidence, entry, stop)"""
    df = spark.createDataFrame(
        rows, "symbol string, signal_type string, source string, strength double, confidence double, entry_price double, stop_loss double"
    )
    return conform(df.withColumn("ts", F.lit(NOW)).withColumn("reasons", F.array("source")), SIGNALS)


def by_symbol(df):
    return {r.symbol: r for r in df.collect()}


# --- contrarian -------------------------------------------------------------


def contrarian_inputs(spark, price=100.0, mood=-2.625, v=0.276667):
    prices = spark.createDataFrame([("600519", price)], "symbol string, price double")
    state = spark.createDataFrame([("600519", mood, 0.0, True, abs(mood), 0.65)],
                                  "symbol string, mood double, roc double, is_extreme boolean, extreme_value double, mean_confidence double")
    value = spark.createDataFrame([("600519", v, "undervalued")], "symbol string, v double, v_label string")
    return prices, state, value


def test_buy_signal_known(spark):
    r = contrarian.contrarian_signals(*contrarian_inputs(spark), NOW).first()
    assert r.signal_type == "BUY"
    assert r.strength == pytest.approx(65.166667, abs=1e-4)
    assert r.confidence == pytest.approx(0.650833, abs=1e-5)
    assert (r.stop_loss, r.take_profit, r.quantity) == (pytest.approx(92.0), pytest.approx(115.0), 13)
    assert r.position_size == pytest.approx(0.01303)
    assert r.reasons == [
        "Sentiment bearish: -2.63", "Undervalued: V=0.277 (undervalued)", "Sentiment extreme: 2.63 std devs from mean"
    ] or r.reasons[0].startswith("Sentiment bearish: -2.6")


def test_hold_when_not_extreme(spark):
    prices, state, value = contrarian_inputs(spark)
    r = contrarian.contrarian_signals(prices, state.withColumn("is_extreme", F.lit(False)), value, NOW).first()
    assert (r.signal_type, r.strength, r.quantity, r.reasons) == ("HOLD", 0.0, None, ["No clear signal"])
    assert r.confidence == pytest.approx(0.325)


def test_snapshot_path_only_holds(spark):
    prices, _, value = contrarian_inputs(spark)
    scores = spark.createDataFrame([("600519", -1.0, 0.6)], "symbol string, score double, confidence double")
    r = contrarian.contrarian_signals(prices, contrarian.snapshot_mood(scores), value, NOW).first()
    assert (r.signal_type, r.sentiment_score) == ("HOLD", -3.0)


def test_trend_completes_the_buy_case(spark):
    prices, state, value = contrarian_inputs(spark, v=0.05)
    run = lambda trend: contrarian.contrarian_signals(prices, state, value.withColumn("trend", F.lit(trend).cast("double")), NOW).first()
    assert run(None).signal_type == "HOLD"
    assert run(0.02).reasons[1] == "Approaching undervaluation: V=0.050, trend=0.020"


@pytest.mark.parametrize("price, text", [(91.5, "Stop-loss hit: 91.50 <= 92.00"), (116.0, "Take-profit hit: 116.00 >= 115.00")])
def test_held_position_exits_first(spark, price, text):
    held = spark.createDataFrame([("600519", "BUY", 92.0, 115.0)], "symbol string, entry_type string, stop_loss double, take_profit double")
    r = contrarian.contrarian_signals(*contrarian_inputs(spark, price=price), NOW, held).first()
    assert (r.signal_type, r.strength, r.confidence, r.reasons) == ("EXIT_LONG", 100.0, 1.0, [text])
    assert r.metadata == {"exit_reason": "EXIT_LONG"} and r.stop_loss is None


def test_reversal_texts(spark):
    held = spark.createDataFrame([("600519", "SELL", 108.0, 85.0)], "symbol string, entry_type string, stop_loss double, take_profit double")
    r = contrarian.contrarian_signals(*contrarian_inputs(spark, mood=-1.2), NOW, held).first()
    assert (r.signal_type, r.reasons) == ("EXIT_SHORT", ["Sentiment reversal: -1.20 < -1.0"])
    r = contrarian.contrarian_signals(*contrarian_inputs(spark, mood=0.0), NOW, held).first()
    assert r.reasons == ["Valuation reversal: 0.277 > 0.05"]


def test_sell_limits_are_their_own(spark):
    p = ContrarianParams(under=0.5, over=-0.2)
    prices, state, value = contrarian_inputs(spark, mood=2.0, v=-0.25)
    assert contrarian.contrarian_signals(prices, state, value, NOW, p=p).first().signal_type == "SELL"
    prices, state, value = contrarian_inputs(spark, mood=2.0, v=-0.15)
    assert contrarian.contrarian_signals(prices, state, value, NOW, p=p).first().signal_type == "HOLD"


# --- valuation --------------------------------------------------------------


def test_valuation_and_intrinsic_known(spark):
    cols = "symbol string, sector string, pe_ratio double, pb_ratio double, dividend_yield double, peg_ratio double, eps double, book_value_per_share double"
    f = spark.createDataFrame([("a", "s", 15.0, 2.5, 0.02, 1.2, 2.0, 8.0), ("b", "t", 1.0, 1.0, 0.0, None, 1.0, 1.0)], cols)
    m = spark.createDataFrame([("s", 25.0, 2.5, 0.015, 1.8)], "sector string, pe_ratio double, pb_ratio double, dividend_yield double, peg_ratio double")
    scored, rejected = valuation.value_companies(f, m)
    (r,) = scored.collect()
    assert r.v == pytest.approx(0.276667, abs=1e-6) and r.label == "undervalued"
    assert r.parts == pytest.approx({"PE": 0.16, "PB": 0.0, "dividend": 0.05, "PEG": 0.066667}, abs=1e-6)
    assert [x.symbol for x in rejected.collect()] == ["b"]
    i = valuation.intrinsic_values(f, m).first()
    assert (i.intrinsic_pe, i.intrinsic_pb, i.intrinsic_gordon, i.intrinsic_value) == (50.0, 20.0, None, 35.0)
    assert i.discount_to_intrinsic == pytest.approx(1 / 6)


# --- strategies -------------------------------------------------------------


def test_momentum_needs_history_and_uses_19_returns(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(20)]
    closes = [100.0] * 15 + [102.0, 104.0, 106.0, 108.0, 110.0]
    bars = spark.createDataFrame([("a", d, c) for d, c in zip(days, closes, strict=True)] + [("b", days[0], 1.0)], "symbol string, day date, close double")
    r = strategies.momentum_signals(bars, days[-1]).collect()
    rets = [closes[i] / closes[i - 1] - 1 for i in range(1, 20)]
    m = sum(rets[-5:]) / 5 - sum(rets) / 19
    assert [(x.symbol, x.signal_type) for x in r] == [("a", "BUY")]
    assert r[0].strength == pytest.approx(min(m * 5000, 100)) and r[0].stop_loss == pytest.approx(110 * 0.92)


def test_breakout(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(20)]
    bars = spark.createDataFrame([("a", d, 100.0 + (i == 19) * 10) for i, d in enumerate(days)], "symbol string, day date, close double")
    (r,) = strategies.breakout_signals(bars, days[-1]).collect()
    assert r.reasons == ["Price 110.00 > MA20 100.50"] and r.strength == 50.0


def test_registry(spark):
    registry = strategies.Registry()
    flat = lambda name: strategies.Strategy(name, lambda t, d: t["x"], ["x"])
    registry.add(flat("sentiment_arb_one"))
    registry.add(flat("contrarian_strategy"))
    registry.add(flat("third"))
    assert registry.weights == {"sentiment_arb_one": 0.6, "contrarian_strategy": 0.4, "third": pytest.approx(1 / 3)}
    registry.remove("third")
    registry.add(strategies.Strategy("broken", lambda t, d: t["absent"], []))
    rows = signals(spark, [("a", "BUY", "?", 50.0, 0.5, 10.0, 9.0)])
    got = registry.collect({"x": rows}, NOW)
    assert {r.source for r in got.collect()} == {"sentiment_arb_one", "contrarian_strategy"}
    registry.set_weights({"a": 1.0, "b": 3.0})
    assert registry.weights == {"a": 0.25, "b": 0.75}


# --- routing ----------------------------------------------------------------

WEIGHTS = {"s1": 0.6, "s2": 0.4}


def test_vote_merge_and_tie(spark):
    df = signals(spark, [
        ("vote", "BUY", "s1", 50.0, 0.5, 10.0, 9.0), ("vote", "SELL", "s2", 90.0, 0.9, 12.0, 13.0),
        ("tie", "BUY", "s1", 40.0, 0.5, 10.0, 9.0), ("tie", "SELL", "s2", 60.0, 0.5, 12.0, 13.0),
        ("agree", "BUY", "s1", 50.0, 0.5, 10.0, None), ("agree", "BUY", "s2", 80.0, 0.9, 12.0, 11.0),
        ("exit", "EXIT_LONG", "s1", 60.0, 0.5, 10.0, None), ("exit", "EXIT_SHORT", "s2", 90.0, 0.5, 10.0, None),
        ("one", "SELL", "s9", 50.0, 0.5, 10.0, 11.0), ("hold", "HOLD", "s1", 0.0, 0.9, 10.0, None),
    ])
    got = by_symbol(routing.resolve(df, WEIGHTS))
    assert (got["vote"].signal_type, got["vote"].source, got["vote"].resolution) == ("SELL", "s2", "weighted")
    assert got["tie"].signal_type == "SELL"
    a = got["agree"]
    w1, w2 = 0.6 * 0.5, 0.4 * 0.9
    assert (a.source, a.resolution, a.stop_loss, a.position_size) == ("router", "consensus", pytest.approx(11.0), None)
    assert a.strength == pytest.approx((50 * w1 + 80 * w2) / (w1 + w2))
    assert a.confidence == pytest.approx((w1 + w2) / 2)
    assert a.reasons == ["s1", "s2"] and a.metadata == {"merged_from": "s1,s2"}
    assert (got["exit"].signal_type, got["exit"].resolution) == ("EXIT_SHORT", "exit_priority")
    assert got["one"].resolution == "single" and "hold" not in got
    dropped = by_symbol(routing.resolve(df, WEIGHTS, RouterParams(require_agreement=True)))["vote"]
    assert (dropped.signal_type, dropped.strength, dropped.source) == ("HOLD", 0.0, "router")


def test_scaling_known(spark):
    df = signals(spark, [(f"x{i}", "BUY", "s1", 100.0, 1.0, 10.0, 9.9) for i in range(25)])
    out = routing.route(df, WEIGHTS, RouterParams(sizing="risk_parity"))
    assert all(r.position_size == pytest.approx(0.04) for r in out.collect())
    s = routing.portfolio_summary(out).first()
    assert (s.long_count, s.short_count, s.signal_count) == (25, 0, 25)
    assert s.total_exposure == pytest.approx(1.0) and s.max_single_position == pytest.approx(0.04)


def test_at_most_fifty(spark):
    df = signals(spark, [(f"x{i:02d}", "BUY", "s1", 40.0 + i / 2, 0.5, 10.0, 9.0) for i in range(80)])
    out = by_symbol(routing.route(df, WEIGHTS))
    assert len(out) == 50 and "x79" in out and "x29" not in out


def test_order_list(spark):
    df = signals(spark, [("a", "BUY", "s1", 50.0, 0.5, 10.0, 9.0), ("b", "EXIT_LONG", "s1", 50.0, 0.5, 10.0, 9.0)])
    (r,) = orders.order_list(df).collect()
    assert (r.order_id, r.side, r.quantity, r.status) == ("ORD_a_20240115143022", "BUY", 100, "dry_run")


# --- orders and positions ---------------------------------------------------


def screen(spark, side, quantity, price, held=0, p=RiskParams(), balance=1e5, loss=0.0, market=10.0, n_other=0):
    req = spark.createDataFrame([("x", side, "limit" if price else "market", quantity, price, None)],
                                "symbol string, side string, order_type string, quantity long, price double, stop_price double")
    pos = spark.createDataFrame([("x", held)] + [(f"o{i}", 1) for i in range(n_other)], "symbol string, quantity long")
    prices = spark.createDataFrame([("x", market)] if market else [], "symbol string, price double")
    return orders.screen_orders(req, pos, prices, balance, loss, p=p).first().fault


def test_order_screen_order_of_checks(spark):
    assert screen(spark, "buy", 20000, 10.0) == "position_limit"
    assert screen(spark, "buy", 100000, 50.0) == "position_limit"
    assert screen(spark, "buy", -100, 10.0) == "invalid_quantity"
    assert screen(spark, "buy", 100, 10.0, n_other=10) == "max_positions"
    assert screen(spark, "buy", 100, 10.0, held=5, n_other=10) is None
    assert screen(spark, "buy", 100, None, market=None) == "no_market_price"
    assert screen(spark, "buy", 9000, 20.0) == "order_value"
    assert screen(spark, "buy", 9000, 11.0, held=900, p=RiskParams(max_total_value=1e5)) == "total_value"
    assert screen(spark, "buy", 100, 10.0, loss=5000.0) == "daily_loss"
    assert screen(spark, "buy", 100, 10.0, balance=999.0) == "insufficient_funds"
    assert screen(spark, "sell", 100, 10.0, held=50) == "insufficient_position"
    assert screen(spark, "sell", 50, 10.0, held=50) is None


def test_position_book_and_marking(spark):
    fills = spark.createDataFrame([("x", 0, 100, 10.0), ("x", 1, 100, 12.0), ("y", 0, 5, 3.0), ("y", 1, -5, 4.0)], "symbol string, n int, qty long, price double")
    prices = spark.createDataFrame([("x", 15.0)], "symbol string, price double")
    book = performance.position_book(fills, ["n"], prices)
    got = by_symbol(book)
    assert (got["x"].avg_cost, got["x"].market_value, got["x"].unrealised) == (11.0, 3000.0, 800.0)
    assert (got["y"].quantity, got["y"].realised_all, got["y"].realised_open, got["y"].avg_cost) == (0, 5.0, 0.0, None)
    total = performance.book_totals(book).first()
    assert (total.num_positions, total.total_realised_all, total.total_quantity) == (1, 5.0, 200)
    a = performance.account_balance(book, 1000.0).first()
    assert (a.total_equity, a.buying_power, a.margin_used) == (4000.0, 2000.0, 1500.0)


def test_trade_statistics_without_losses(spark):
    trades = spark.createDataFrame([("x", 0, "BUY", 10.0, 10.0, 1.0), ("x", 1, "SELL", 10.0, 12.0, 1.0)],
                                   "symbol string, n int, side string, quantity double, price double, commission double")
    s = performance.trade_statistics(performance.round_trips(trades, ["n"])).first()
    assert (s.n_pairs, s.win_rate, s.profit_factor, s.no_losses) == (1, 1.0, None, True)
    none = performance.trade_statistics(performance.round_trips(trades.filter("side = 'BUY'"), ["n"])).first()
    assert (none.n_pairs, none.win_rate, none.profit_factor, none.no_losses) == (0, 0.0, 0.0, False)


def test_mark_to_market(spark):
    day = lambda d: dt.date(2024, 1, d)
    trades = spark.createDataFrame([("x", day(1), "BUY", 10.0, 10.0, 1.0, 0.0), ("x", day(3), "SELL", 4.0, 12.0, 1.0, 2.0)],
                                   "symbol string, day date, side string, quantity double, fill_price double, commission double, stamp_duty double")
    bars = spark.createDataFrame([("x", day(2), 11.0), ("x", day(3), 13.0), ("y", day(4), 5.0)], "symbol string, day date, close double")
    got = {r.date.day: (r.cash, r.positions_value, r.equity) for r in performance.mark_to_market(trades, bars, 1000.0, ["day"]).collect()}
    assert got == {1: (899.0, 100.0, 999.0), 2: (899.0, 110.0, 1009.0), 3: (944.0, 78.0, 1022.0), 4: (944.0, 78.0, 1022.0)}
    # of several bars a day the last counts, and a fill does not replace an older close
    hours = spark.createDataFrame([("x", day(1), 9, 12.0), ("x", day(1), 15, 9.0)], "symbol string, day date, hour int, close double")
    got = {r.date.day: r.positions_value for r in performance.mark_to_market(trades, hours, 1000.0, ["day"], "hour").collect()}
    assert got == {1: 90.0, 3: 54.0}


def test_orders_without_a_fill(spark):
    orders = spark.createDataFrame([(1, 10), (2, 10)], "order_id int, quantity int")
    fills = spark.createDataFrame([(1, 4, 2.0)], "order_id int, quantity int, price double")
    from sentifold.plans.orders import order_fills

    got = {r.order_id: (r.filled_quantity, r.avg_fill_price, r.status, r.remaining_quantity) for r in order_fills(orders, fills).collect()}
    assert got == {1: (4, 2.0, "partially_filled", 6), 2: (0, None, "pending", 10)}
    kept = order_fills(orders.selectExpr("*", "'cancelled' AS status"), fills).filter("order_id = 2").first()
    assert kept.status == "cancelled"


def test_curve_measures(spark):
    curve = spark.createDataFrame([(dt.date(2024, 1, d), e) for d, e in ((1, 100.0), (2, 110.0), (3, 99.0))], "date date, equity double")
    r = performance.curve_measures(curve, CostParams(initial_capital=100.0), stop=False).first()
    assert r.total_return == pytest.approx(-0.01) and r.max_drawdown == pytest.approx(0.1)
    assert r.sharpe_ratio == pytest.approx(0.0, abs=1e-9)
    assert r.annualized_return == pytest.approx(0.99 ** (365 / 2) - 1)


ENTRY = "symbol string, day date, signal_type string, entry_price double, stop_loss double, take_profit double"


def test_first_touch(spark):
    day = lambda d: dt.date(2024, 1, d)
    bars = spark.createDataFrame([("x", day(d), c) for d, c in enumerate([100.0, 95.0, 91.0, 120.0, 100.0], 1)], "symbol string, day date, close double")
    entry = spark.createDataFrame(
        [("x", day(1), "BUY", 100.0, 92.0, 115.0), ("x", day(4), "BUY", 120.0, 90.0, 130.0), ("y", day(4), "BUY", 1.0, 0.9, 1.3)], ENTRY
    )
    got = {(r.symbol, r.day.day): (r.exit_reason, r.exit_day, r.exit_return) for r in performance.first_touch(entry, bars).collect()}
    assert got == {("x", 1): ("stop_loss", day(3), pytest.approx(-0.09)), ("x", 4): ("open", None, None), ("y", 4): ("open", None, None)}


def test_first_touch_after_many_bars_and_off_bars(spark):
    start = dt.date(2020, 1, 1)
    day = lambda d: start + dt.timedelta(days=2 * d)
    bars = spark.createDataFrame([("x", day(d), 100.0 if d < 65 else 50.0) for d in range(70)], "symbol string, day date, close double")
    entry = spark.createDataFrame([("x", day(0), "BUY", 100.0, 92.0, 115.0), ("x", day(0) - dt.timedelta(days=9), "BUY", 100.0, 92.0, 115.0),
                                   ("x", day(3) + dt.timedelta(days=1), "SELL", 100.0, 108.0, 50.0)], ENTRY)
    out = performance.first_touch(entry, bars).collect()
    assert {r.day: (r.exit_reason, r.exit_day) for r in out} == {
        day(0): ("stop_loss", day(65)), day(0) - dt.timedelta(days=9): ("stop_loss", day(65)), day(3) + dt.timedelta(days=1): ("take_profit", day(65)),
    }


@pytest.mark.parametrize(("fan", "limit"), [(3, None), (4, 40)])
def test_first_hit_equals_a_walk(spark, fan, limit):
    import random

    from pyspark.sql import functions as F

    from sentifold.operators.touch import first_hit

    rng = random.Random(9)
    rows = [("ab"[i % 7 == 0], i, rng.randrange(100)) for i in rng.sample(range(400), 200)]
    asks = [(rng.choice("abc"), rng.randrange(420), n, rng.choice([1, 5, 50, 200])) for n in range(150)]
    got = first_hit(
        spark.createDataFrame(asks, "k string, at int, n int, bound int"), spark.createDataFrame(rows, "k string, at int, v int"),
        "k", "at", ["v"], lambda low, high: high("v") >= F.col("bound"), ["n"], limit, fan,
    )
    want = {n: min((i for s, i, v in rows if s == k and i > at and v >= bound), default=None) for k, at, n, bound in asks}
    assert {r.n: r.found and r.found["at"] for r in got.collect()} == want
