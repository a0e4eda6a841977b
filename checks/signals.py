"""Strategies and the routing of their signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentifold.functions import trading as ft
from sentifold.operators.cooldown import accept_after_cooldown
from sentifold.operators.series import (
    with_confirmation,
    with_enough_rows,
    with_momentum,
    with_moving_average,
    with_return,
    with_return_zscore,
)
from sentifold.params import ContrarianParams, DislocationParams, MomentumParams, RouterParams
from sentifold.plans import contrarian as pc
from sentifold.plans import mood as pm
from sentifold.plans import routing as pr
from sentifold.plans import strategies as ps
from sentifold.plans import valuation as pv
from sentifold.plans.orders import order_list

from .case import Case, day, rounded, rq
from .market import TS, D
from .views import sql

AS_OF = "2024-02-01"
# Prices are short decimals: nine digits leave no rounding ties.
P = {"entry_price": 9, "stop_loss": 9, "take_profit": 9}
WEIGHTS = {"purchase": 0.6, "click": 0.4, "view": 0.3, "signup": 0.25}
WEIGHT_SQL = "CASE source WHEN 'purchase' THEN 0.6 WHEN 'click' THEN 0.4 WHEN 'view' THEN 0.3 WHEN 'signup' THEN 0.25 ELSE 1.0 END::DOUBLE"
# Lower limits than the defaults, so that every branch occurs in the given tables.
LOOSE = ContrarianParams(mood_limit=0.5, roc_limit=0.2, under=0.05, over=-0.05)


def _state(t):
    """Mood with the extreme test widened, so that entries occur."""
    return pm.mood_state(t.mood).withColumn("is_extreme", F.col("extreme_value") >= 0.4)


def _valued(t):
    k = F.col("symbol").cast("bigint")
    return pv.market_valuation(t.fundamentals).withColumn("trend", F.when(k % 3 == 0, (k % 5 - 2) / 10.0))


def _contrarian(t, positions=None):
    return pc.contrarian_signals(t.last_price, _state(t), _valued(t), AS_OF, positions, LOOSE)


def _signal_columns(df):
    return rounded(df.select(
        "symbol", "signal_type", "strength", "confidence", "entry_price", "stop_loss", "take_profit", "position_size",
        F.col("quantity").cast("double").alias("quantity"), "sentiment_score", "valuation_score",
        F.size("reasons").cast("bigint").alias("n_reasons"),
        F.substring_index(F.col("reasons")[0], ":", 1).alias("first_reason")), 5, **P)


def _clip100(text: str) -> str:
    return f"greatest(least({text}, 100), 0)"


CONTRARIAN = {
    "facts": """SELECT symbol, price, mood, roc, extreme_value, mean_confidence, v, extreme_value >= 0.4 AS ext,
      CASE WHEN CAST(symbol AS BIGINT) % 3 = 0 THEN CAST(CAST(symbol AS BIGINT) % 5 - 2 AS DOUBLE) / 10 END AS trend
      FROM last_price JOIN mood_now USING (symbol) JOIN market_value USING (symbol)""",
    "conditions": f"""SELECT *,
      (mood < -0.5 OR roc < -0.2) AND (v > 0.05 OR (v > 0 AND coalesce(trend > 0, false))) AND ext AS buy,
      (mood > 0.5 OR roc > 0.2) AND (v < -0.05 OR (v < 0 AND coalesce(trend < 0, false))) AND ext AS sell,
      {_clip100('(greatest(-mood, 0) / 3.5 * 0.5 + least(v, 0.5) / 0.5 * 0.5) * 100')} AS buy_strength,
      {_clip100('(greatest(mood, 0) / 3.5 * 0.5 + least(-v, 0.5) / 0.5 * 0.5) * 100')} AS sell_strength FROM facts""",
    "exits": """SELECT c.*, h.entry_type, CASE WHEN h.symbol IS NULL THEN NULL
      WHEN entry_type = 'BUY' AND price <= stop_loss OR entry_type = 'SELL' AND price >= stop_loss THEN 'Stop-loss hit'
      WHEN entry_type = 'BUY' AND price >= take_profit OR entry_type = 'SELL' AND price <= take_profit THEN 'Take-profit hit'
      WHEN entry_type = 'BUY' AND mood > 1 OR entry_type = 'SELL' AND mood < -1 THEN 'Sentiment reversal'
      WHEN entry_type = 'BUY' AND v < 0.05 OR entry_type = 'SELL' AND v > 0.05 THEN 'Valuation reversal' END AS why
      FROM conditions c LEFT JOIN held h USING (symbol)""",
    "decided": """SELECT *, CASE WHEN why IS NOT NULL THEN CASE WHEN entry_type = 'BUY' THEN 'EXIT_LONG' ELSE 'EXIT_SHORT' END
        WHEN buy AND (NOT sell OR buy_strength >= sell_strength) THEN 'BUY' WHEN sell THEN 'SELL' ELSE 'HOLD' END AS signal_type
      FROM exits""",
    "rated": """SELECT *, CASE WHEN why IS NOT NULL THEN 100.0 WHEN signal_type = 'BUY' THEN buy_strength
      WHEN signal_type = 'SELL' THEN sell_strength ELSE 0.0 END::DOUBLE AS strength FROM decided""",
    "counted": """SELECT *, CASE WHEN signal_type IN ('BUY', 'SELL') AND strength > 20
      THEN round(least(1000 * (strength / 50) / price, 5000 / price), 2) END AS shares FROM rated""",
}
CONTRARIAN_FREE = {**CONTRARIAN, "exits": "SELECT *, CAST(NULL AS VARCHAR) AS entry_type, CAST(NULL AS VARCHAR) AS why FROM conditions"}

CONTRARIAN_BODY = f"""SELECT symbol, signal_type, {rq('strength', 5)} AS strength,
  {rq('CASE WHEN why IS NOT NULL THEN 1.0 ELSE (strength / 100 + mean_confidence) / 2 END', 5)} AS confidence,
  {rq('price', 9)} AS entry_price,
  {rq("CASE signal_type WHEN 'BUY' THEN price * 0.92 WHEN 'SELL' THEN price * 1.08 END", 9)} AS stop_loss,
  {rq("CASE signal_type WHEN 'BUY' THEN price * 1.15 WHEN 'SELL' THEN price * 0.85 END", 9)} AS take_profit,
  {rq('shares * price / 100000', 5)} AS position_size,
  CASE WHEN shares <> 0 THEN floor(shares) END AS quantity,
  {rq('mood', 5)} AS sentiment_score, {rq('v', 5)} AS valuation_score,
  CASE WHEN signal_type IN ('BUY', 'SELL') THEN 3 ELSE 1 END::BIGINT AS n_reasons,
  CASE WHEN why IS NOT NULL THEN why WHEN signal_type = 'HOLD' THEN 'No clear signal'
    WHEN signal_type = 'BUY' AND mood < -0.5 THEN 'Sentiment bearish' WHEN signal_type = 'BUY' THEN 'Sentiment rapidly deteriorating'
    WHEN mood > 0.5 THEN 'Sentiment bullish' ELSE 'Sentiment rapidly improving' END AS first_reason
  FROM counted"""

# --- price strategies -------------------------------------------------------

RETURNS = {
    "returns": """SELECT symbol, day, close, close / lag(close) OVER w - 1 AS ret, lag(bars.day) OVER w AS before,
      row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)""",
    "scored": """SELECT a.symbol, a.day, any_value(a.close) AS close, any_value(a.ret) AS ret, count(b.ret) AS n,
      (any_value(a.ret) - avg(b.ret)) / stddev_samp(b.ret) AS z
      FROM returns a JOIN returns b ON a.symbol = b.symbol AND b.day <= a.day AND b.before >= a.day - 252 GROUP BY a.symbol, a.day""",
}
DISLOCATION = {
    **RETURNS,
    "placed": """SELECT symbol, day, close, z, score, score - z AS gap FROM (SELECT s.symbol, s.day, s.close, s.z,
      CASE WHEN s.day - m.day <= 252 THEN m.score ELSE 0 END AS score
      FROM (SELECT * FROM scored WHERE n >= 20) s ASOF LEFT JOIN brand_mood m ON s.symbol = m.symbol AND s.day >= m.day)""",
    "called": """SELECT *, CASE WHEN score > 1.5 AND z < -0.5 AND gap > 2 THEN 'BUY'
      WHEN score < -1.5 AND z > 0.5 AND gap < -2 THEN 'SELL' END AS signal_type FROM placed""",
}

def levels(stop: float, target: float, price: str = "close") -> str:
    return (
        f"{rq(f'CASE signal_type WHEN {chr(39)}BUY{chr(39)} THEN {price} * (1 - {stop}) ELSE {price} * (1 + {stop}) END', 9)} AS stop_loss, "
        f"{rq(f'CASE signal_type WHEN {chr(39)}BUY{chr(39)} THEN {price} * (1 + {target}) ELSE {price} * (1 - {target}) END', 9)} AS take_profit"
    )


MOMENTUM = {
    "returns": RETURNS["returns"],
    "windowed": """SELECT symbol, day, close, count(*) OVER r AS rows30,
      avg(ret) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS quick,
      avg(ret) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS slow,
      avg(ret) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS slow19,
      avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma
      FROM returns WINDOW r AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)""",
    "moved": """SELECT *, CASE WHEN rows30 > 20 THEN quick - slow WHEN rows30 = 20 THEN quick - slow19 END AS momentum FROM windowed""",
    "called": """SELECT *, CASE WHEN momentum > 0.005 THEN 'BUY' WHEN momentum < -0.005 THEN 'SELL' END AS signal_type FROM moved""",
}

PRICE_COLS = ("symbol", "ts", "signal_type", "strength", "confidence", "entry_price", "stop_loss", "take_profit")

# --- routing ----------------------------------------------------------------

AVG = ("strength", "entry_price", "stop_loss", "take_profit", "sentiment_score", "valuation_score")


def _resolved_views(agree: bool = False) -> dict[str, str]:
    avgs = ", ".join(
        f"sum({a} * w * confidence) / sum(CASE WHEN {a} IS NOT NULL THEN w * confidence END) AS {a}" for a in AVG
    )
    cols = "run, symbol, signal_type, source, strength, confidence, entry_price, stop_loss, take_profit, position_size, sentiment_score, valuation_score, reasons"
    own = cols.replace("reasons", "reason AS reasons")
    dropped = f"""UNION ALL SELECT DISTINCT run, symbol, 'HOLD', 'router', 0.0, 0.0, NULL, NULL, NULL, NULL, NULL, NULL,
      'Conflicting signals dropped due to require_agreement', 'dropped' FROM grouped WHERE n > 1 AND n_exit = 0 AND n_buy > 0 AND n_sell > 0"""
    mixed = "AND NOT (n_buy > 0 AND n_sell > 0)" if agree else ""
    return {
        "weighted": f"SELECT *, {WEIGHT_SQL} AS w FROM signals WHERE confidence >= 0.3 AND strength >= 30",
        "grouped": """SELECT *, count(*) OVER g AS n, count(*) FILTER (signal_type = 'EXIT_LONG') OVER g AS n_exit,
          count(*) FILTER (signal_type = 'BUY') OVER g AS n_buy, count(*) FILTER (signal_type = 'SELL') OVER g AS n_sell,
          coalesce(sum(w * strength * confidence) FILTER (signal_type = 'BUY') OVER g, 0) AS buy_vote,
          coalesce(sum(w * strength * confidence) FILTER (signal_type = 'SELL') OVER g, 0) AS sell_vote
          FROM weighted WINDOW g AS (PARTITION BY run, symbol)""",
        "winners": f"""SELECT *, CASE WHEN n_buy > 0 AND n_sell > 0 THEN 'weighted' ELSE 'consensus' END AS resolution,
          count(*) OVER (PARTITION BY run, symbol) AS n_side FROM grouped
          WHERE n > 1 AND n_exit = 0 {mixed} AND signal_type = CASE WHEN n_sell = 0 THEN 'BUY' WHEN n_buy = 0 THEN 'SELL'
            WHEN buy_vote > sell_vote THEN 'BUY' ELSE 'SELL' END""",
        "resolved": f"""SELECT {own}, 'single' AS resolution FROM grouped WHERE n = 1
          UNION ALL SELECT {cols}, 'exit_priority' FROM (SELECT {own},
            row_number() OVER (PARTITION BY run, symbol ORDER BY strength DESC, source) AS rn FROM grouped
            WHERE n > 1 AND signal_type = 'EXIT_LONG') WHERE rn = 1
          UNION ALL SELECT {own}, resolution FROM winners WHERE n_side = 1
          UNION ALL SELECT run, symbol, signal_type, 'router', strength, wc / n_side, entry_price, stop_loss, take_profit,
            NULL, sentiment_score, valuation_score, reasons, resolution FROM (
            SELECT run, symbol, signal_type, resolution, n_side, {avgs}, sum(w * confidence) AS wc,
              string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons FROM winners WHERE n_side > 1 GROUP BY ALL)
          {dropped if agree else ''}""",
    }


def _size(sizing: str) -> str:
    if sizing == "risk_parity":
        return "CASE WHEN stop_loss IS NOT NULL THEN 0.02 / greatest(abs(entry_price - stop_loss) / entry_price, 0.01) ELSE 0.02 END"
    return "0.02" if sizing == "equal" else "0.02 * (strength / 50) * confidence"


def _routed_views(sizing: str = "signal_strength", keep: int = 50, limit: float = 1.0) -> dict[str, str]:
    return {
        **_resolved_views(),
        "sized": f"SELECT * REPLACE (least(coalesce(position_size, {_size(sizing)}), 0.05) AS position_size) FROM resolved",
        "kept": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY strength * confidence DESC, symbol) AS rn
          FROM sized) WHERE rn <= {keep}""",
        "scaled": f"""SELECT * REPLACE (position_size * CASE WHEN signal_type IN ('BUY', 'SELL') AND total > {limit}
          THEN {limit} / total ELSE 1 END AS position_size) FROM (
          SELECT *, sum(CASE WHEN signal_type IN ('BUY', 'SELL') THEN position_size ELSE 0 END) OVER (PARTITION BY run) AS total FROM kept)""",
    }


ROUTE_BODY = f"""SELECT {day('run')} AS run, symbol, signal_type, source, {rq('strength')} AS strength, {rq('confidence')} AS confidence,
  {rq('position_size')} AS position_size FROM scaled"""


def _routed(t, **params):
    out = pr.route(t.signals, WEIGHTS, RouterParams(**params), ["run"])
    return rounded(out.select("run", "symbol", "signal_type", "source", "strength", "confidence", "position_size"))


def _resolved(t, **params):
    p = RouterParams(**params)
    out = pr.resolve(pr.passing(t.signals, p), WEIGHTS, p, ["run"])
    return rounded(out.select(
        "run", "symbol", "signal_type", "source", "strength", "confidence", "entry_price", "stop_loss", "take_profit",
        "sentiment_score", "valuation_score", F.array_join("reasons", "|").alias("reasons"), "resolution"), 8)


RESOLVE_BODY = f"""SELECT {day('run')} AS run, symbol, signal_type, source, {rq('strength', 8)} AS strength, {rq('confidence', 8)} AS confidence,
  {rq('entry_price', 8)} AS entry_price, {rq('stop_loss', 8)} AS stop_loss, {rq('take_profit', 8)} AS take_profit,
  {rq('sentiment_score', 8)} AS sentiment_score, {rq('valuation_score', 8)} AS valuation_score, reasons, resolution FROM resolved"""


POINTS = {
    "latest": """SELECT symbol, score FROM (SELECT symbol, score, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn
      FROM composite) WHERE rn = 1""",
    "pointed": """SELECT symbol, price, coalesce(score, 0) AS s, coalesce(
      CASE WHEN nullif(pe_ratio, 0) < 15 THEN 0.2 WHEN pe_ratio > 30 THEN -0.2 ELSE 0 END::DOUBLE
      + CASE WHEN nullif(pb_ratio, 0) < 1.5 THEN 0.15 WHEN pb_ratio > 4 THEN -0.15 ELSE 0 END::DOUBLE
      + CASE WHEN roe > 0.15 THEN 0.1 ELSE 0 END::DOUBLE, 0) AS v
      FROM last_price LEFT JOIN fundamentals USING (symbol) LEFT JOIN latest USING (symbol)""",
    "called": """SELECT *, CASE WHEN s < -0.15 AND v > 0.10 THEN 'BUY' WHEN s > 0.15 AND v < -0.10 THEN 'SELL' END AS signal_type
      FROM pointed""",
}


def _snapshot_registry():
    registry = ps.Registry()
    registry.add(ps.Strategy(
        "points", lambda t, d: ps.points_signals(t["prices"], t["fundamentals"], t["scores"], d),
        ["prices", "fundamentals", "scores"]))
    registry.add(ps.Strategy("mean_mood", lambda t, d: ps.mean_mood_signals(t["raw"], t["prices"], d), ["raw", "prices"]))
    return registry


def _snapshot_tables(t):
    return {
        "prices": t.last_price, "fundamentals": t.fundamentals, "raw": t.sentiment_raw,
        "scores": t.composite.groupBy("symbol").agg(F.max_by("score", "day").alias("score")),
    }


def _registry():
    registry = ps.Registry()
    registry.add(ps.Strategy("sentiment_arbitrage", lambda t, d: ps.dislocation_signals(t["bars"], t["mood"], d), ["bars", "mood"]))
    registry.add(ps.Strategy("momentum", lambda t, d: ps.momentum_signals(t["bars"], d, MomentumParams(min_rows=15, slow=15)), ["bars"]))
    registry.add(ps.Strategy("breakout", lambda t, d: ps.breakout_signals(t["bars"], d), ["bars"]))
    return registry


def _plug(t):
    return {"bars": t.bars.select("symbol", "day", "close"), "mood": t.brand_mood}


def _bar_signals(as_of: str) -> dict[str, str]:
    """What the three bar strategies of ``_registry`` say on a day."""
    recent = f"day BETWEEN DATE '{as_of}' - {{}} AND DATE '{as_of}'"
    walk = """SELECT symbol, day, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret,
      row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back FROM {}"""
    last = "max(CASE WHEN back = 1 THEN {0} END) AS {0}"
    return {
        "year": f"SELECT symbol, day, close FROM bars WHERE {recent.format(252)}",
        "month": f"SELECT symbol, day, close FROM bars WHERE {recent.format(30)}",
        "year_walk": walk.format("year"),
        "month_walk": walk.format("month"),
        "year_scored": f"""SELECT symbol, {last.format('day')}, {last.format('close')},
          (max(CASE WHEN back = 1 THEN ret END) - avg(ret)) / stddev_samp(ret) AS z, count(ret) AS n FROM year_walk GROUP BY symbol""",
        "year_placed": f"""SELECT s.symbol, s.close, s.z, coalesce(m.score, 0) AS score FROM year_scored s
          ASOF LEFT JOIN (SELECT * FROM brand_mood WHERE {recent.format(252)}) m ON s.symbol = m.symbol AND s.day >= m.day WHERE n >= 20""",
        "month_scored": f"""SELECT symbol, {last.format('close')}, count(*) AS n, avg(CASE WHEN back <= 20 THEN close END) AS ma,
          avg(CASE WHEN back <= 5 THEN ret END) - avg(CASE WHEN back <= 15 THEN ret END) AS m FROM month_walk GROUP BY symbol""",
        "entries_": """SELECT symbol, 'sentiment_arbitrage' AS source, least((abs(score) + abs(z) + abs(score - z)) * 10, 100) AS strength,
            {arbitrage}::DOUBLE AS confidence, close AS entry_price, 0.15 AS down, 0.20 AS up, score AS sentiment_score,
            CASE WHEN score > 1.5 AND z < -0.5 AND score - z > 2 THEN 'BUY' WHEN score < -1.5 AND z > 0.5 AND score - z < -2 THEN 'SELL' END AS signal_type
          FROM year_placed
          UNION ALL SELECT symbol, 'momentum', least(abs(m) * 5000, 100), 0.6::DOUBLE, close, 0.08, 0.15, NULL,
            CASE WHEN m > 0.005 THEN 'BUY' WHEN m < -0.005 THEN 'SELL' END FROM month_scored WHERE n >= 15
          UNION ALL SELECT symbol, 'breakout', 50.0::DOUBLE, 0.5::DOUBLE, close, NULL, NULL, NULL,
            CASE WHEN close > ma * 1.02 THEN 'BUY' END FROM month_scored WHERE n >= 20""".replace("{arbitrage}", str(DislocationParams().confidence)),
        "bar_signals": """SELECT 0 AS run, symbol, source, signal_type, strength, confidence, entry_price, source AS reason,
          entry_price * CASE signal_type WHEN 'BUY' THEN 1 - down ELSE 1 + down END AS stop_loss,
          entry_price * CASE signal_type WHEN 'BUY' THEN 1 + up ELSE 1 - up END AS take_profit,
          CAST(NULL AS DOUBLE) AS position_size, sentiment_score, CAST(NULL AS DOUBLE) AS valuation_score FROM entries_ WHERE signal_type IS NOT NULL""",
    }


EVENT_TIMES = "SELECT symbol, ts, event_id, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS n FROM sentiment_raw"

CASES = [
    Case(
        "contrarian_signals", "K6, C6, H21, H22, H24, H25, H26",
        lambda t: _signal_columns(_contrarian(t)), sql(CONTRARIAN_BODY, **CONTRARIAN_FREE),
    ),
    Case(
        "contrarian_signals_with_exits", "K6, C16, H23",
        lambda t: _signal_columns(_contrarian(t, t.held)), sql(CONTRARIAN_BODY, **CONTRARIAN),
    ),
    Case(
        "held_exits", "C16, H23",
        lambda t: rounded(pc.held_exits(t.held, t.last_price, pm.mood_state(t.mood), pv.market_valuation(t.fundamentals)).select(
            "symbol", "signal_type", "reason", "price"), 9),
        sql(f"""SELECT symbol, CASE WHEN entry_type = 'BUY' THEN 'EXIT_LONG' ELSE 'EXIT_SHORT' END AS signal_type, reason, {rq('price', 9)} AS price
          FROM (SELECT symbol, entry_type, price, CASE
            WHEN entry_type = 'BUY' AND price <= stop_loss OR entry_type = 'SELL' AND price >= stop_loss THEN 'stop_loss'
            WHEN entry_type = 'BUY' AND price >= take_profit OR entry_type = 'SELL' AND price <= take_profit THEN 'take_profit'
            WHEN v IS NULL THEN NULL
            WHEN entry_type = 'BUY' AND mood > 1 OR entry_type = 'SELL' AND mood < -1 THEN 'sentiment_reversal'
            WHEN mood IS NOT NULL AND (entry_type = 'BUY' AND v < 0.05 OR entry_type = 'SELL' AND v > 0.05) THEN 'valuation_reversal' END AS reason
            FROM held JOIN last_price USING (symbol) LEFT JOIN mood_now USING (symbol) LEFT JOIN market_value USING (symbol))
          WHERE reason IS NOT NULL"""),
    ),
    Case(
        "points_signals", "K8, C7, H32",
        lambda t: rounded(ps.points_signals(
            t.last_price, t.fundamentals, t.composite.groupBy("symbol").agg(F.max_by("score", "day").alias("score")), AS_OF).select(
            "symbol", "signal_type", "strength", "entry_price", "stop_loss", "take_profit", "sentiment_score", "valuation_score",
            F.substring_index(F.col("reasons")[0], ":", 1).alias("first_reason")), 5, **P),
        sql(f"""SELECT symbol, signal_type, {rq('least(abs(s) * 20 + abs(v) * 50, 100)', 5)} AS strength, {rq('price', 9)} AS entry_price,
          {levels(0.08, 0.15, 'price')}, {rq('s', 5)} AS sentiment_score, {rq('v', 5)} AS valuation_score,
          CASE signal_type WHEN 'BUY' THEN 'Bearish sentiment' ELSE 'Bullish sentiment' END AS first_reason FROM called WHERE signal_type IS NOT NULL""",
          **POINTS),
    ),
    Case(
        "simple_returns", "E7", lambda t: rounded(with_return(t.bars.select("symbol", "day", "close"), ["symbol"], ["day"]).select("symbol", "day", "ret")),
        sql(f"SELECT symbol, {day()} AS day, {rq('ret')} AS ret FROM returns", **RETURNS),
    ),
    Case(
        "minimum_history", "B7",
        lambda t: with_enough_rows(t.bars, ["symbol"], 20),
        sql("SELECT symbol, count(*) AS n_rows FROM bars GROUP BY symbol HAVING count(*) >= 20"),
    ),
    Case(
        "return_zscores", "E8",
        lambda t: rounded(with_return_zscore(t.bars.select("symbol", "day", "close"), ["symbol"]).filter("z_score is not null").select("symbol", "day", "z_score"), 5),
        sql(f"SELECT symbol, {day()} AS day, {rq('z', 5)} AS z_score FROM scored WHERE n >= 20", **RETURNS),
    ),
    Case(
        "dislocation_signals", "K7, E9, H24",
        lambda t: rounded(ps.dislocation_signals(t.bars.select("symbol", "day", "close"), t.brand_mood).select(
            F.to_date("ts").alias("day"), "symbol", "signal_type", "strength", "entry_price", "stop_loss", "take_profit",
            "sentiment_score", "price_z_score", "dislocation"), 5, **P),
        sql(f"""SELECT symbol, {day()} AS day, signal_type, {rq('least((abs(score) + abs(z) + abs(gap)) * 10, 100)', 5)} AS strength,
          {rq('close', 9)} AS entry_price, {levels(0.15, 0.20)}, {rq('score', 5)} AS sentiment_score, {rq('z', 5)} AS price_z_score,
          {rq('gap', 5)} AS dislocation FROM called WHERE signal_type IS NOT NULL""", **DISLOCATION),
    ),
    Case(
        "dislocation_signals_of_day", "K7",
        lambda t: rounded(ps.dislocation_signals(t.bars.select("symbol", "day", "close"), t.brand_mood, D("2001-01-21")).select(
            F.to_date("ts").alias("day"), "symbol", "signal_type", "strength", "entry_price"), 5, **P),
        sql(f"""SELECT symbol, '2001-01-21' AS day, signal_type, {rq('least((abs(score) + abs(z) + abs(gap)) * 10, 100)', 5)} AS strength,
          {rq('close', 9)} AS entry_price FROM called WHERE signal_type IS NOT NULL""", **{
            "recent": "SELECT symbol, day, close FROM bars WHERE day BETWEEN DATE '2001-01-21' - 252 AND DATE '2001-01-21'",
            **DISLOCATION,
            "returns": """SELECT symbol, day, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret,
              row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back FROM recent""",
            "scored": """SELECT symbol, max(CASE WHEN back = 1 THEN day END) AS day, max(CASE WHEN back = 1 THEN close END) AS close,
              (max(CASE WHEN back = 1 THEN ret END) - avg(ret)) / stddev_samp(ret) AS z, count(ret) AS n FROM returns GROUP BY symbol""",
        }),
    ),
    Case(
        "momentum_signals_of_day", "K9",
        lambda t: rounded(ps.momentum_signals(t.bars.select("symbol", "day", "close"), D("2001-01-21")).select(
            F.to_date("ts").alias("day"), "symbol", "signal_type", "strength", "entry_price"), 5, **P),
        sql(f"""SELECT symbol, '2001-01-21' AS day, CASE WHEN m > 0 THEN 'BUY' ELSE 'SELL' END AS signal_type, {rq('least(abs(m) * 5000, 100)', 5)} AS strength,
          {rq('close', 9)} AS entry_price FROM moved WHERE n >= 20 AND abs(m) > 0.005""",
            recent="SELECT symbol, day, close FROM bars WHERE day BETWEEN DATE '2001-01-21' - 30 AND DATE '2001-01-21'",
            returns="""SELECT symbol, day, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret,
              row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back FROM recent""",
            moved="""SELECT symbol, max(CASE WHEN back = 1 THEN day END) AS day, max(CASE WHEN back = 1 THEN close END) AS close,
              avg(CASE WHEN back <= 5 THEN ret END) - avg(CASE WHEN back <= 20 THEN ret END) AS m, count(*) AS n FROM returns GROUP BY symbol"""),
    ),
    Case(
        "momentum", "E10",
        lambda t: rounded(with_momentum(t.bars.select("symbol", "day", "close"), ["symbol"]).filter("momentum is not null").select("symbol", "day", "momentum")),
        sql(f"SELECT symbol, {day()} AS day, {rq('momentum')} AS momentum FROM moved WHERE momentum IS NOT NULL", **MOMENTUM),
    ),
    Case(
        "momentum_signals", "K9",
        lambda t: rounded(ps.momentum_signals(t.bars.select("symbol", "day", "close")).select(*PRICE_COLS), 5, **P),
        sql(f"""SELECT symbol, {day()} || ' 00:00:00.000000' AS ts, signal_type, {rq('least(abs(momentum) * 5000, 100)', 5)} AS strength,
          0.6::DOUBLE AS confidence, {rq('close', 9)} AS entry_price, {levels(0.08, 0.15)} FROM called WHERE signal_type IS NOT NULL""", **MOMENTUM),
    ),
    Case(
        "mean_mood_signals", "K9, D4",
        lambda t: rounded(ps.mean_mood_signals(t.sentiment_raw, t.last_price, TS("2024-01-25")).select(
            "symbol", "signal_type", "strength", "confidence", "entry_price", "sentiment_score"), 5, **P),
        sql(f"""SELECT symbol, CASE WHEN m > 0 THEN 'BUY' ELSE 'SELL' END AS signal_type, {rq('least(abs(m) * 50, 100)', 5)} AS strength,
          0.7::DOUBLE AS confidence, {rq('price', 9)} AS entry_price, {rq('m', 5)} AS sentiment_score
          FROM (SELECT symbol, avg(score) AS m FROM sentiment_raw WHERE ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-25' GROUP BY symbol)
          JOIN last_price USING (symbol) WHERE abs(m) > 0.5"""),
    ),
    Case(
        "moving_averages", "E16",
        lambda t: rounded(with_moving_average(t.bars.select("symbol", "day", "close"), ["symbol"]).filter("moving_average is not null").select("symbol", "day", "moving_average"), 5),
        sql(f"SELECT symbol, {day()} AS day, {rq('ma', 5)} AS moving_average FROM windowed WHERE rows30 >= 20", **MOMENTUM),
    ),
    Case(
        "breakout_signals", "K10, E16",
        lambda t: rounded(ps.breakout_signals(t.bars.select("symbol", "day", "close")).select(
            F.to_date("ts").alias("day"), "symbol", "signal_type", "strength", "confidence", "entry_price"), 5, **P),
        sql(f"""SELECT symbol, {day()} AS day, 'BUY' AS signal_type, 50.0::DOUBLE AS strength, 0.5::DOUBLE AS confidence, {rq('close', 9)} AS entry_price
          FROM windowed WHERE rows30 >= 20 AND close > ma * 1.02""", **MOMENTUM),
    ),
    Case(
        "confirmed_signals", "E18",
        lambda t: rounded(with_confirmation(t.signals.select("symbol", "run", "source", "signal_type"), ["symbol"], ["run", "source"])),
        sql(f"""SELECT symbol, {day('run')} AS run, source, signal_type, coalesce(lag(signal_type) OVER (PARTITION BY symbol ORDER BY signals.run, source)
          = signal_type, false) AS confirmed FROM signals"""),
    ),
    Case(
        "cooled_signals", "E22",
        lambda t: rounded(accept_after_cooldown(t.sentiment_raw.select("symbol", "ts", "event_id"), ["symbol"], "ts", ["event_id"], 1440).filter("accepted").select("symbol", "event_id")),
        sql("""SELECT symbol, event_id FROM walk WHERE accepted""", ordered=EVENT_TIMES,
            walk="""SELECT symbol, n, event_id, ts AS last_ts, true AS accepted FROM ordered WHERE n = 1 UNION ALL
              SELECT o.symbol, o.n, o.event_id, CASE WHEN o.ts >= w.last_ts + INTERVAL 1440 MINUTES THEN o.ts ELSE w.last_ts END,
              o.ts >= w.last_ts + INTERVAL 1440 MINUTES FROM walk w JOIN ordered o ON o.symbol = w.symbol AND o.n = w.n + 1"""),
    ),
    Case(
        "signal_history", "F5",
        lambda t: rounded(pc.recent_signals(t.signals.select("run", "symbol", "source", "ts", "signal_type"), 30)),
        sql("""SELECT CAST(run AS VARCHAR) AS run, symbol, source, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, signal_type FROM signals
          ORDER BY signals.ts DESC, symbol, source LIMIT 30"""),
    ),
    Case(
        "signals_of_type", "B4, B5, H27",
        lambda t: rounded(t.signals.filter(ft.is_entry(F.col("signal_type")) | (F.col("symbol") == "7")).select(
            "run", "symbol", "source", "signal_type", ft.is_exit(F.col("signal_type")).alias("is_exit"),
            ft.strength_level(F.col("strength")).alias("level"))),
        sql(f"""SELECT {day('run')} AS run, symbol, source, signal_type, signal_type = 'EXIT_LONG' AS is_exit, CASE WHEN strength >= 70 THEN 'STRONG'
          WHEN strength >= 40 THEN 'MODERATE' ELSE 'WEAK' END AS level FROM signals WHERE signal_type IN ('BUY', 'SELL') OR symbol = '7'"""),
    ),
    Case(
        "signals_of_type_and_symbol", "B5",
        lambda t: rounded(pr.signals_of(t.signals, ["BUY", "EXIT_LONG"], [str(i) for i in range(40)]).select("run", "symbol", "source", "signal_type", "strength")),
        sql(f"""SELECT {day('run')} AS run, symbol, source, signal_type, {rq('strength')} AS strength FROM signals
          WHERE signal_type IN ('BUY', 'EXIT_LONG') AND CAST(symbol AS BIGINT) < 40"""),
    ),
    # --- routing ------------------------------------------------------------
    Case(
        "passing_signals", "B3", lambda t: rounded(pr.passing(t.signals).select("run", "symbol", "source", "strength", "confidence")),
        sql(f"""SELECT {day('run')} AS run, symbol, source, {rq('strength')} AS strength, {rq('confidence')} AS confidence FROM signals
          WHERE confidence >= 0.3 AND strength >= 30"""),
    ),
    Case(
        "weighted_signals", "C12, J2",
        lambda t: rounded(t.signals.select("run", "symbol", "source", pr.weight_of(F.col("source"), WEIGHTS).alias("w"))),
        sql(f"SELECT {day('run')} AS run, symbol, source, {rq(WEIGHT_SQL)} AS w FROM signals"),
    ),
    Case("resolved_signals", "K11, D9, D10, F6", lambda t: _resolved(t), sql(RESOLVE_BODY, **_resolved_views())),
    Case(
        "resolved_signals_agreeing", "K11, D10", lambda t: _resolved(t, require_agreement=True),
        sql(RESOLVE_BODY, **_resolved_views(True)),
    ),
    Case("routed_by_strength", "K11, H31, F4, D11", lambda t: _routed(t), sql(ROUTE_BODY, **_routed_views())),
    Case("routed_equal", "K11, H31", lambda t: _routed(t, sizing="equal"), sql(ROUTE_BODY, **_routed_views("equal"))),
    Case(
        "routed_risk_parity", "K11, H31", lambda t: _routed(t, sizing="risk_parity"),
        sql(ROUTE_BODY, **_routed_views("risk_parity")),
    ),
    Case(
        "routed_strongest_scaled", "F4, D11", lambda t: _routed(t, max_signals=20, max_exposure=0.1),
        sql(ROUTE_BODY, **_routed_views("signal_strength", 20, 0.1)),
    ),
    Case(
        "portfolio_summaries", "D8", lambda t: rounded(pr.portfolio_summary(pr.route(t.signals, WEIGHTS, RouterParams(), ["run"]), ["run"])),
        sql(f"""SELECT {day('run')} AS run, count(*) FILTER (signal_type = 'BUY') AS long_count, count(*) FILTER (signal_type = 'SELL') AS short_count,
          {rq("sum(CASE WHEN signal_type IN ('BUY', 'SELL') THEN position_size ELSE 0 END)")} AS total_exposure,
          {rq("sum(CASE signal_type WHEN 'BUY' THEN position_size WHEN 'SELL' THEN -position_size ELSE 0 END)")} AS net_exposure,
          {rq('max(position_size)')} AS max_single_position, count(*) AS signal_count, {rq('bought / sold')} AS long_short_ratio,
          coalesce(bought / sold > 2, false) AS ratio_exceeded FROM (SELECT *,
            sum(CASE WHEN signal_type = 'BUY' THEN position_size END) OVER (PARTITION BY run) AS bought,
            sum(CASE WHEN signal_type = 'SELL' THEN position_size END) OVER (PARTITION BY run) AS sold FROM scaled)
          GROUP BY run, bought, sold""", **_routed_views()),
    ),
    Case(
        "order_list", "K20, B9, H41",
        lambda t: order_list(pr.route(t.signals, WEIGHTS, RouterParams(), ["run"])),
        sql("""SELECT 'ORD_' || symbol || '_' || strftime(max_ts, '%Y%m%d%H%M%S') AS order_id, symbol, signal_type AS side, 100::BIGINT AS quantity,
          'MARKET' AS order_type, 'dry_run' AS status, source AS source_signal FROM (
          SELECT s.*, (SELECT max(ts) FROM weighted w WHERE w.run = s.run AND w.symbol = s.symbol AND w.signal_type = s.signal_type
            AND (s.source = 'router' OR w.source = s.source)) AS max_ts FROM scaled s WHERE signal_type IN ('BUY', 'SELL'))""", **_routed_views()),
    ),
    Case(
        "registry_union", "J1, J4, G2",
        lambda t: rounded(_snapshot_registry().collect(_snapshot_tables(t), TS("2024-01-25")).select(
            "symbol", "source", "signal_type", "strength", "confidence", "sentiment_score"), 5),
        sql(f"""SELECT symbol, 'points' AS source, signal_type, {rq('least(abs(s) * 20 + abs(v) * 50, 100)', 5)} AS strength, 0.6::DOUBLE AS confidence,
            {rq('s', 5)} AS sentiment_score FROM called WHERE signal_type IS NOT NULL
          UNION ALL SELECT symbol, 'mean_mood', CASE WHEN m > 0 THEN 'BUY' ELSE 'SELL' END, {rq('least(abs(m) * 50, 100)', 5)}, 0.7::DOUBLE, {rq('m', 5)}
          FROM (SELECT symbol, avg(score) AS m FROM sentiment_raw WHERE ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-25' GROUP BY symbol)
          JOIN last_price USING (symbol) WHERE abs(m) > 0.5""", **POINTS),
    ),
    Case(
        "registry_union_of_bars", "J1, J2, J4, G2",
        lambda t: _registry().collect(_plug(t), D("2001-01-20")).groupBy("source", "signal_type").agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT source, signal_type, count(*) AS n FROM bar_signals GROUP BY source, signal_type", **_bar_signals("2001-01-20")),
    ),
    Case(
        "combined_strategy", "J3",
        lambda t: rounded(ps.combined(_registry()).signals(_plug(t), D("2001-01-20")).select(
            "symbol", "signal_type", "source", "strength", "confidence", "position_size")),
        sql(f"""SELECT symbol, signal_type, 'combined' AS source, {rq('strength')} AS strength, {rq('confidence')} AS confidence,
          {rq('position_size')} AS position_size FROM scaled""", **{**_bar_signals("2001-01-20"), **_routed_views(), "weighted":
          """SELECT *, CASE source WHEN 'sentiment_arbitrage' THEN 0.6 WHEN 'momentum' THEN 1 / 2 ELSE 1 / 3 END::DOUBLE AS w
            FROM bar_signals WHERE confidence >= 0.3 AND strength >= 30"""}),
    ),
]
