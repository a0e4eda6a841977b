"""Formulas against values worked by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sentifold.functions import basic, mood, trading, value
from sentifold.params import ContrarianParams, CostParams, RouterParams

lit = F.lit


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x, want", [(0.5, 0.5), (-0.5, -0.5), (2.0, 1.0), (-2.0, -1.0)])
def test_rescale(spark, x, want):
    assert one(spark, mood.rescale(lit(x))) == pytest.approx(want)


def test_clip_keeps_null(spark):
    assert one(spark, basic.clip(lit(None).cast("double"), -1.0, 1.0)) is None


@pytest.mark.parametrize(
    "x, want",
    [(-4, "extreme_bearish"), (-2, "bearish"), (0, "neutral"), (2, "bullish"), (4, "extreme_bullish"),
     (-3.0, "extreme_bearish"), (-1.5, "bearish"), (1.5, "bullish"), (3.0, "extreme_bullish")],
)
def test_mood_label(spark, x, want):
    assert one(spark, mood.mood_label(lit(float(x)))) == want


@pytest.mark.parametrize("x, want", [(0.31, "bullish"), (0.3, "neutral"), (-0.3, "neutral"), (-0.31, "bearish")])
def test_tone(spark, x, want):
    assert one(spark, mood.tone(lit(x))) == want


@pytest.mark.parametrize(
    "pct, change, score", [(1.0, 2.5, 0.6), (1.0, -2.5, -0.6), (0.95, 0.0, 0.3), (0.5, -3.0, 0.1), (0.05, 9.0, 0.0)]
)
def test_social(spark, pct, change, score):
    assert one(spark, mood.social_score(lit(pct), lit(change))) == pytest.approx(score)


def test_forum_and_search(spark):
    ratio = mood.flow_ratio(lit(5e6), lit(2e6))
    assert one(spark, mood.forum_score(ratio, lit(0.0))) == pytest.approx(0.428571, abs=1e-6)
    drift = mood.margin_drift(lit(1.5e7))
    assert one(spark, mood.search_score(drift, mood.volume_ratio(lit(2e7)))) == pytest.approx(0.7)


@pytest.mark.parametrize("raw, want", [(0.0, -1.0), (0.75, 0.5), (1.0, 1.0), (-0.4, -0.4), (3.0, 1.0), (-7.0, -1.0)])
def test_article(spark, raw, want):
    assert one(spark, mood.article_score(lit(raw))) == pytest.approx(want)


@pytest.mark.parametrize("ratio, change, want", [(2.0, -0.03, -0.7), (2.0, 0.03, 0.7), (2.0, 0.0, 0.3), (1.5, 0.5, 0.0)])
def test_interest(spark, ratio, change, want):
    assert one(spark, mood.interest_score(lit(ratio), lit(change))) == want


@pytest.mark.parametrize("code, want", [("SH600519", "600519"), ("BJ1", "1"), ("SZ", "SZ"), ("600519", "600519")])
def test_strip_exchange(spark, code, want):
    assert one(spark, basic.strip_exchange(lit(code))) == want


@pytest.mark.parametrize("text, drop, want", [("1,234.5", ",", 1234.5), ("0.8%", "%", 0.8), ("--", ",", 0.0), (None, ",", 0.0)])
def test_parse_number(spark, text, drop, want):
    assert one(spark, basic.parse_number(lit(text).cast("string"), drop)) == want


def test_ids(spark):
    ts = lit("2024-01-15 14:30:22").cast("timestamp_ntz")
    assert one(spark, basic.id_text(lit("600519"), ts)) == "600519_20240115_143022"
    assert one(spark, basic.id_text(lit("600519"), ts, "_EXIT")) == "600519_20240115_143022_EXIT"
    assert one(spark, basic.order_id_text(lit("600519"), ts)) == "ORD_600519_20240115143022"


def test_parse_iso(spark):
    as_of = lit("2024-02-01").cast("timestamp_ntz")
    assert one(spark, basic.parse_iso(lit("2024-01-15T14:30:22"), as_of)) == dt.datetime(2024, 1, 15, 14, 30, 22)
    assert one(spark, basic.parse_iso(lit("soon"), as_of)) == dt.datetime(2024, 2, 1)


def test_valuation(spark):
    gaps = [
        value.ratio_gap(lit(15.0), lit(25.0)),
        value.ratio_gap(lit(2.5), lit(2.5)),
        value.dividend_gap(lit(0.02), lit(0.015)),
        value.ratio_gap(lit(1.2), lit(1.8)),
    ]
    assert [one(spark, g) for g in gaps] == pytest.approx([-0.4, 0.0, 1 / 3, -1 / 3])
    v = one(spark, value.value_score(*gaps))
    assert v == pytest.approx(0.276667, abs=1e-6)
    assert one(spark, value.value_label(lit(v))) == "undervalued"


def test_valuation_edges(spark):
    assert one(spark, value.ratio_gap(lit(-3.0), lit(25.0))) == 0.0
    assert one(spark, value.ratio_gap(lit(None).cast("double"), lit(25.0))) == 0.0
    assert one(spark, value.dividend_gap(lit(0.01), lit(0.0))) == 1.0
    assert one(spark, value.dividend_gap(lit(0.0), lit(0.0))) == 0.0
    assert one(spark, value.own_pe(lit(0.0), lit(12.0))) == 12.0
    assert one(spark, value.own_pe(lit(None).cast("double"), lit(0.0))) == 0.0


def test_intrinsic(spark):
    fair = value.mean_of_present(
        value.fair_by_multiple(lit(2.0), lit(25.0)),
        value.fair_by_multiple(lit(8.0), lit(2.5)),
        value.gordon_value(lit(0.16), lit(0.02), 0.03),
    )
    assert one(spark, fair) == 35.0
    assert one(spark, value.implied_price(lit(15.0), lit(2.0), lit(2.5), lit(8.0))) == 30.0
    assert one(spark, value.gordon_value(lit(0.4), lit(0.02), 0.05)) == pytest.approx(0.4 * 1.03 / 0.02)
    assert one(spark, value.mean_of_present(lit(None).cast("double"))) is None


def test_verdict(spark):
    assert one(spark, value.combined_score(lit(-2.15), lit(0.25))) == pytest.approx(51.75)
    assert one(spark, value.verdict(lit(-2.15), lit(0.25))) == "BUY"
    assert one(spark, value.verdict_confidence(lit(-2.15), lit(0.25))) == pytest.approx(0.9)
    assert one(spark, value.verdict(lit(0.5), lit(-0.05), bottom=False)) == "SELL"
    assert one(spark, value.verdict(lit(0.5), lit(0.05), bottom=False)) == "HOLD"


def test_buy_case(spark):
    strength = one(spark, trading.conviction(lit(-2.625), lit(0.276667)))
    assert strength == pytest.approx(65.166667, abs=1e-4)
    assert one(spark, trading.share_count(lit(strength), lit(100.0))) == pytest.approx(13.03)
    assert one(spark, trading.stop_level(lit("BUY"), lit(100.0), 0.08)) == pytest.approx(92.0)
    assert one(spark, trading.target_level(lit("SELL"), lit(100.0), 0.15)) == pytest.approx(85.0)


@pytest.mark.parametrize(
    "side, price, m, v, want",
    [
        ("BUY", 91.5, 0.0, 0.3, "stop_loss"),
        ("BUY", 116.0, 0.0, 0.3, "take_profit"),
        ("BUY", 100.0, 1.1, 0.3, "sentiment_reversal"),
        ("BUY", 100.0, 0.0, 0.04, "valuation_reversal"),
        ("BUY", 100.0, 0.0, 0.3, None),
        ("BUY", 100.0, None, 0.04, None),
        ("SELL", 108.5, 0.0, -0.3, "stop_loss"),
        ("SELL", 84.0, 0.0, -0.3, "take_profit"),
        ("SELL", 100.0, -1.1, -0.3, "sentiment_reversal"),
        ("SELL", 100.0, 0.0, 0.06, "valuation_reversal"),
    ],
)
def test_exit_reason(spark, side, price, m, v, want):
    stop, target = (92.0, 115.0) if side == "BUY" else (108.0, 85.0)
    reason = trading.exit_reason(lit(side), lit(price), lit(stop), lit(target), lit(m).cast("double"), lit(v))
    assert one(spark, reason) == want


def test_costs(spark):
    assert one(spark, trading.commission(lit(10000.0))) == 5.0
    assert one(spark, trading.stamp_duty(lit("SELL"), lit(10000.0))) == 10.0
    assert one(spark, trading.stamp_duty(lit("BUY"), lit(10000.0))) == 0.0
    assert one(spark, trading.fill_price(lit("BUY"), lit(100.0))) == pytest.approx(100.1)
    assert one(spark, trading.fill_price(lit("SELL"), lit(100.0), "vwap")) == pytest.approx(100 * 0.999 * 0.999)
    free = CostParams(slippage=0.0)
    assert one(spark, trading.fill_price(lit("BUY"), lit(100.0), p=free)) == 100.0


def test_sizing(spark):
    args = (lit(80.0), lit(0.5), lit(100.0), lit(92.0))
    assert one(spark, trading.position_fraction(*args)) == pytest.approx(0.02 * 1.6 * 0.5)
    assert one(spark, trading.position_fraction(*args, RouterParams(sizing="equal"))) == 0.02
    assert one(spark, trading.position_fraction(*args, RouterParams(sizing="risk_parity"))) == pytest.approx(0.25)


@pytest.mark.parametrize(
    "symbol, quantity, kind, price, stop, want",
    [
        ("", 10, "market", None, None, "invalid_symbol"),
        ("a", -100, "market", None, None, "invalid_quantity"),
        ("a", 10, "limit", None, None, "limit_price_missing"),
        ("a", 10, "stop", None, None, "stop_price_missing"),
        ("a", 10, "limit", -1.0, None, "price_not_positive"),
        ("a", 10, "stop", None, 0.0, "stop_price_not_positive"),
        ("a", 10, "market", None, None, None),
    ],
)
def test_request_fault(spark, symbol, quantity, kind, price, stop, want):
    number = lambda x: lit(x).cast("double")
    assert one(spark, trading.request_fault(lit(symbol), lit(quantity), lit(kind), number(price), number(stop))) == want


def test_stop_loss(spark):
    assert one(spark, trading.stop_loss_hit(lit(10), lit(100.0), lit(95.0))) is True
    assert one(spark, trading.stop_loss_hit(lit(10), lit(100.0), lit(95.1))) is False
    assert one(spark, trading.stop_loss_hit(lit(-10), lit(100.0), lit(105.0))) is True


def test_levels(spark):
    assert [one(spark, trading.strength_level(lit(x))) for x in (70.0, 40.0, 39.9)] == ["STRONG", "MODERATE", "WEAK"]
    assert [one(spark, value.verdict_strength(lit(x))) for x in (-0.7, 0.4, 0.39)] == ["STRONG", "MODERATE", "WEAK"]


def test_conviction_bounds(spark):
    p = ContrarianParams()
    assert one(spark, trading.conviction(lit(-50.0), lit(9.0), p)) == 100.0
    assert one(spark, trading.conviction(lit(3.0), lit(-2.0), p)) == 0.0
    assert not math.isnan(one(spark, trading.conviction(lit(0.0), lit(0.0), p)))
