"""Ledgers, orders, costs, equity and performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentifold.functions import trading as ft
from sentifold.operators import ledger
from sentifold.operators.asof import asof_join
from sentifold.operators.series import cut_after_breach, with_drawdown, with_return
from sentifold.params import CostParams, RiskParams
from sentifold.plans import orders as po
from sentifold.plans import performance as pp
from sentifold.plans import strategies as ps
from sentifold.sources import store

from .case import Case, day, rounded, rq, stamp
from .signals import MOMENTUM
from .tables import FILL_ORDER
from .views import sql

CAPITAL = 1e9
CURVE = CostParams(initial_capital=CAPITAL)
WIDE = RiskParams(max_position=5000, max_total_value=1e12, max_positions=10**6, max_order_value=20000.0, max_daily_loss=5000.0)
BIG_LIMITS = 20  # custom limits for symbols divisible by this


def _costed(t):
    return pp.cost_trades(t.fills)


def _limits(t):
    return t.positions.filter(F.col("symbol").cast("bigint") % BIG_LIMITS == 0).select(
        "symbol", F.lit(300).cast("bigint").alias("position_limit"))


def _screen(t, p, loss=0.0, custom=False):
    return po.screen_orders(
        t.requests, t.positions, t.last_price.filter(F.col("symbol").cast("bigint") % 13 != 0),
        F.col("balance"), loss, _limits(t) if custom else None, p,
    ).select("request_id", "fault", "fault_kind")


def _screen_sql(p: RiskParams, loss: float, custom: bool) -> str:
    limit = f"CASE WHEN CAST(r.symbol AS BIGINT) % {BIG_LIMITS} = 0 AND h.symbol IS NOT NULL THEN 300 ELSE {p.max_position} END"
    if not custom:
        limit = str(p.max_position)
    return sql(
        """SELECT request_id, fault, CASE WHEN fault IS NULL THEN NULL
             WHEN fault IN ('invalid_symbol', 'invalid_quantity', 'insufficient_funds', 'insufficient_position') THEN fault
             WHEN fault IN ('limit_price_missing', 'stop_price_missing', 'price_not_positive', 'stop_price_not_positive', 'no_market_price')
               THEN 'invalid_price' ELSE 'risk_limit_exceeded' END AS fault_kind FROM screened""",
        priced="SELECT * FROM last_price WHERE CAST(symbol AS BIGINT) % 13 <> 0",
        held_total="""SELECT count(*) FILTER (quantity <> 0) AS n_open, sum(abs(quantity) * coalesce(price, 0)) AS held_value
          FROM positions LEFT JOIN priced USING (symbol)""",
        looked_up=f"""SELECT r.*, coalesce(h.quantity, 0) AS held_qty, coalesce(r.price, m.price) AS use_price,
          CASE WHEN r.symbol = '' THEN 0 ELSE {limit} END AS lim,
          coalesce(h.quantity, 0) + CASE WHEN side = 'buy' THEN r.quantity ELSE -r.quantity END AS new_qty
          FROM requests r LEFT JOIN positions h ON r.symbol = h.symbol LEFT JOIN priced m ON r.symbol = m.symbol""",
        screened=f"""SELECT request_id, CASE WHEN symbol = '' THEN 'invalid_symbol' WHEN quantity <= 0 THEN 'invalid_quantity'
          WHEN order_type IN ('limit', 'stop_limit') AND price IS NULL THEN 'limit_price_missing'
          WHEN order_type IN ('stop', 'stop_limit') AND stop_price IS NULL THEN 'stop_price_missing'
          WHEN price <= 0 THEN 'price_not_positive' WHEN stop_price <= 0 THEN 'stop_price_not_positive'
          WHEN abs(new_qty) > lim THEN 'position_limit'
          WHEN held_qty = 0 AND new_qty <> 0 AND n_open >= {p.max_positions} THEN 'max_positions'
          WHEN use_price IS NULL THEN 'no_market_price'
          WHEN use_price * quantity > {p.max_order_value} THEN 'order_value'
          WHEN held_value + use_price * quantity > {p.max_total_value} THEN 'total_value'
          WHEN {loss} >= {p.max_daily_loss} THEN 'daily_loss'
          WHEN side = 'buy' AND use_price * quantity > balance THEN 'insufficient_funds'
          WHEN side = 'sell' AND quantity > abs(held_qty) THEN 'insufficient_position' END AS fault FROM looked_up CROSS JOIN held_total""",
    )


# First-in-first-out by simulation: the open queue length, row by row.
FIFO = {
    "numbered": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, l_orderkey, l_linenumber) AS n FROM fills",
    "walk": """SELECT symbol, n, CASE WHEN side = 'BUY' THEN 1 ELSE 0 END AS open_after, 0 AS open_before, side FROM numbered WHERE n = 1
      UNION ALL SELECT f.symbol, f.n, CASE WHEN f.side = 'BUY' THEN w.open_after + 1 ELSE greatest(w.open_after - 1, 0) END,
      w.open_after, f.side FROM walk w JOIN numbered f ON f.symbol = w.symbol AND f.n = w.n + 1""",
    "pairable": "SELECT symbol, n, side FROM walk WHERE side = 'BUY' OR open_before > 0",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY n) AS pair_no FROM pairable",
    "costed": """SELECT *, fill_price * quantity AS notional, greatest(fill_price * quantity * 0.0003, 5) AS commission,
      CASE WHEN side = 'SELL' THEN fill_price * quantity * 0.001 ELSE 0 END AS stamp_duty FROM (
      SELECT *, price * CASE WHEN side = 'BUY' THEN 1 + 0.001::DOUBLE ELSE 1 - 0.001::DOUBLE END AS fill_price FROM numbered)""",
    "pairs": """SELECT *, (sell_price - buy_price) * sell_quantity - (sell_commission + buy_commission) AS pnl FROM (
      SELECT b.symbol, b.pair_no, bt.price AS buy_price, st.price AS sell_price, st.quantity AS sell_quantity,
        bt.commission AS buy_commission, st.commission AS sell_commission
      FROM ranked b JOIN ranked s ON b.symbol = s.symbol AND b.pair_no = s.pair_no AND b.side = 'BUY' AND s.side = 'SELL'
      JOIN costed bt ON bt.symbol = b.symbol AND bt.n = b.n JOIN costed st ON st.symbol = s.symbol AND st.n = s.n)""",
}
STATS = {
    **FIFO,
    "stats": """SELECT count(*) AS n_pairs, count(*) FILTER (pnl > 0) AS wins, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gross_profit,
      sum(CASE WHEN pnl > 0 THEN 0 ELSE -pnl END) AS gross_loss, avg(CASE WHEN pnl > 0 THEN pnl END) AS mean_win,
      avg(CASE WHEN pnl > 0 THEN NULL ELSE -pnl END) AS mean_loss FROM pairs""",
}

# Average cost by simulation: quantity, cost and profit, row by row.
BOOK = {
    "numbered": FIFO["numbered"],
    "cost_walk": """SELECT symbol, n, price, qty AS q, price AS c, 0.0::DOUBLE AS all_pnl, 0.0::DOUBLE AS open_pnl FROM numbered WHERE n = 1
      UNION ALL SELECT f.symbol, f.n, f.price, w.q + f.qty,
        CASE WHEN w.q = 0 THEN f.price WHEN sign(w.q) = sign(f.qty) THEN (w.q * w.c + f.qty * f.price) / (w.q + f.qty)
          WHEN abs(f.qty) > abs(w.q) THEN f.price ELSE w.c END,
        w.all_pnl + CASE WHEN w.q <> 0 AND sign(w.q) <> sign(f.qty)
          THEN (f.price - w.c) * least(abs(f.qty), abs(w.q)) * sign(w.q) ELSE 0 END,
        CASE WHEN w.q + f.qty = 0 THEN 0 ELSE w.open_pnl + CASE WHEN w.q <> 0 AND sign(w.q) <> sign(f.qty)
          THEN (f.price - w.c) * least(abs(f.qty), abs(w.q)) * sign(w.q) ELSE 0 END END
      FROM cost_walk w JOIN numbered f ON f.symbol = w.symbol AND f.n = w.n + 1""",
    "book": """SELECT symbol, q AS quantity, CASE WHEN q <> 0 THEN c END AS avg_cost, price AS current_price, abs(q) * price AS market_value,
      CASE WHEN q <> 0 THEN (price - c) * q ELSE 0 END AS unrealised, open_pnl AS realised_open, all_pnl AS realised_all,
      CASE WHEN q > 0 THEN (price - c) / c WHEN q < 0 THEN (c - price) / c END AS return_pct, n AS n_fills
      FROM cost_walk JOIN (SELECT symbol, max(n) AS n FROM numbered GROUP BY symbol) USING (symbol, n)""",
}

DRAW = {
    "peaked": "SELECT *, greatest(max(equity) OVER (ORDER BY date), 1e9) AS peak FROM equity",
    "fallen": "SELECT *, (peak - equity) / peak AS drawdown FROM peaked",
}


def _curve_sql(limit: float | None) -> dict[str, str]:
    cut = f"WHERE date <= coalesce((SELECT min(date) FROM fallen WHERE drawdown >= {limit}), DATE '9999-01-01')" if limit else ""
    return {
        **DRAW,
        "cut_curve": f"SELECT *, (equity - lag(equity) OVER (ORDER BY date)) / lag(equity) OVER (ORDER BY date) AS daily FROM (SELECT * FROM fallen {cut})",
        "measures": """SELECT *, (final_capital - 1e9) / 1e9 AS total_return, greatest(days / 365.0, 1.0::DOUBLE / 252) AS years FROM (
          SELECT arg_max(equity, date) AS final_capital, max(drawdown) AS max_drawdown, avg(daily) AS m, stddev_pop(daily) AS s,
          (SELECT CAST(max(date) - min(date) AS DOUBLE) FROM fallen) AS days, count(*) AS n_days FROM cut_curve)""",
    }


MEASURES = f"""1e9::DOUBLE AS initial_capital, {rq('final_capital', 2)} AS final_capital, {rq('total_return')} AS total_return,
  {rq('pow(1 + total_return, 1 / years) - 1')} AS annualized_return, {rq('CASE WHEN s > 0 THEN m / s * sqrt(252) ELSE 0 END')} AS sharpe_ratio,
  {rq('max_drawdown')} AS max_drawdown"""

# For every (symbol, day): what is held and at which price, looked up rather than accumulated.
MARKED = {
    "costed": FIFO["costed"].replace("numbered", "fills"),
    "part_trades": """SELECT p_brand AS symbol, day, side, quantity, fill_price, commission, stamp_duty, ts, l_orderkey, l_linenumber
      FROM costed JOIN part ON symbol = CAST(p_partkey AS VARCHAR)""",
    "moves": """SELECT symbol, day, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS dq,
      sum(-CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END * fill_price - commission - stamp_duty) AS flow,
      arg_max(fill_price, {'ts': ts, 'o': l_orderkey, 'l': l_linenumber}) AS fill FROM part_trades GROUP BY symbol, day""",
    "hours": """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, l_linenumber AS hour,
      sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE / sum(l_quantity) AS close
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "closes": "SELECT symbol, day, arg_max(close, hour) AS close FROM hours GROUP BY symbol, day",
    "days": "SELECT DISTINCT day FROM (SELECT day FROM moves UNION ALL SELECT day FROM closes)",
    "symbols": "SELECT DISTINCT symbol FROM (SELECT symbol FROM moves UNION ALL SELECT symbol FROM closes)",
    "grid": """SELECT s.symbol, d.day, coalesce(m.dq, 0) AS dq, coalesce(m.flow, 0) AS flow, b.close, m.fill
      FROM symbols s CROSS JOIN days d LEFT JOIN moves m ON m.symbol = s.symbol AND m.day = d.day
      LEFT JOIN closes b ON b.symbol = s.symbol AND b.day = d.day""",
    "valued": """SELECT symbol, day, flow, sum(dq) OVER w *
      coalesce(last_value(close IGNORE NULLS) OVER w, last_value(fill IGNORE NULLS) OVER w) AS value FROM grid
      WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "daily_value": "SELECT day, sum(value) AS positions_value, sum(flow) AS flow FROM valued GROUP BY day",
}


def _brand_trades(t):
    part = t.read("part").select(F.col("p_partkey").cast("string").alias("symbol"), "p_brand")
    return _costed(t).join(part, "symbol").withColumn("symbol", F.col("p_brand"))


def _hours(t):
    """Bars with several closes a day, in the order of ``hour``."""
    line, part = t.read("lineitem"), t.read("part")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return (
        line.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").alias("hour"))
        .agg((cents / 100.0 / F.sum("l_quantity")).alias("close"))
    )


def _entries(t):
    s = ps.momentum_signals(t.bars.select("symbol", "day", "close"))
    return s.select("symbol", F.to_date("ts").alias("day"), "signal_type", "entry_price", "stop_loss", "take_profit")


def _mood_bars(t):
    bars = asof_join(t.bars.select("symbol", "day", "close"), t.brand_mood, ["symbol"], "day", "score")
    return bars.withColumnRenamed("score", "mood").withColumn("v", F.when(F.col("mood").isNotNull(), 0.06))


def _touch_sql(views: dict[str, str], entry: str, bars: str, why: str) -> str:
    return sql(
        f"""SELECT e.symbol, {day('e.day')} AS day, e.signal_type, {rq('e.entry_price', 9)} AS entry_price, {day('h.exit_day')} AS exit_day,
          coalesce(h.reason, 'open') AS exit_reason,
          {rq("CASE WHEN e.signal_type = 'BUY' THEN h.close / e.entry_price - 1 ELSE 1 - h.close / e.entry_price END")} AS exit_return
          FROM entries e LEFT JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY symbol, entry_day ORDER BY exit_day) = 1) h
          ON h.symbol = e.symbol AND h.entry_day = e.day""",
        **views,
        walked=bars,
        entries=f"""SELECT *, close AS entry_price, CASE signal_type WHEN 'BUY' THEN close * 0.92 ELSE close * 1.08 END AS stop_loss,
          CASE signal_type WHEN 'BUY' THEN close * 1.15 ELSE close * 0.85 END AS take_profit FROM ({entry})""",
        hits=f"""SELECT * FROM (SELECT e.symbol, e.day AS entry_day, b.day AS exit_day, b.close, {why} AS reason
          FROM entries e JOIN walked b ON b.symbol = e.symbol AND b.day > e.day) WHERE reason IS NOT NULL""",
    )


STOPS = """CASE WHEN e.signal_type = 'BUY' AND b.close <= stop_loss OR e.signal_type = 'SELL' AND b.close >= stop_loss THEN 'stop_loss'
  WHEN e.signal_type = 'BUY' AND b.close >= take_profit OR e.signal_type = 'SELL' AND b.close <= take_profit THEN 'take_profit'"""

CASES = [
    Case(
        "fifo_pairs", "C15, E14",
        lambda t: rounded(ledger.fifo_pairs(t.fills, ["symbol"], FILL_ORDER, ["ts", "price", "quantity"])),
        sql(f"""SELECT b.symbol, b.pair_no, {stamp('bt.ts')} AS buy_ts, {rq('bt.price')} AS buy_price, bt.quantity AS buy_quantity,
          {stamp('st.ts')} AS sell_ts, {rq('st.price')} AS sell_price, st.quantity AS sell_quantity
          FROM ranked b JOIN ranked s ON b.symbol = s.symbol AND b.pair_no = s.pair_no AND b.side = 'BUY' AND s.side = 'SELL'
          JOIN numbered bt ON bt.symbol = b.symbol AND bt.n = b.n JOIN numbered st ON st.symbol = s.symbol AND st.n = s.n""", **FIFO),
    ),
    Case(
        "position_book", "K15, D15, H34",
        lambda t: rounded(pp.position_book(t.fills, FILL_ORDER), 4),
        sql(f"""SELECT symbol, quantity, {rq('avg_cost', 4)} AS avg_cost, {rq('current_price', 4)} AS current_price, {rq('market_value', 4)} AS market_value,
          {rq('unrealised', 4)} AS unrealised, {rq('realised_open', 4)} AS realised_open, {rq('realised_all', 4)} AS realised_all,
          {rq('return_pct', 4)} AS return_pct, n_fills FROM book""", **BOOK),
    ),
    Case(
        "fill_ledger", "D15, K15",
        lambda t: rounded(ledger.cost_ledger(t.fills, ["symbol"], FILL_ORDER).select(
            "symbol", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "quantity_after", "avg_cost_after", "realised"), 4),
        sql(f"""SELECT symbol, f.l_orderkey, CAST(f.l_linenumber AS BIGINT) AS l_linenumber, w.q AS quantity_after,
          {rq('CASE WHEN w.q <> 0 THEN w.c END', 4)} AS avg_cost_after, {rq('w.all_pnl - coalesce(b.all_pnl, 0)', 4)} AS realised
          FROM cost_walk w JOIN numbered f USING (symbol, n) LEFT JOIN cost_walk b ON b.symbol = w.symbol AND b.n = w.n - 1""".replace(
            "SELECT symbol,", "SELECT w.symbol,"), **BOOK),
    ),
    Case(
        "position_totals", "D12", lambda t: rounded(pp.book_totals(pp.position_book(t.fills, FILL_ORDER)), 2),
        sql(f"""SELECT count(*) FILTER (quantity <> 0) AS num_positions, {rq('sum(market_value)', 2)} AS total_market_value,
          {rq('sum(unrealised)', 2)} AS total_unrealised, {rq('sum(realised_open)', 2)} AS total_realised_open,
          {rq('sum(realised_all)', 2)} AS total_realised_all, CAST(sum(abs(quantity)) AS BIGINT) AS total_quantity FROM book""", **BOOK),
    ),
    Case(
        "account_balance", "D13", lambda t: rounded(pp.account_balance(pp.position_book(t.fills, FILL_ORDER), 1e6), 2),
        sql(f"""SELECT {rq('1000000 + sum(market_value)', 2)} AS total_equity, 1000000.0::DOUBLE AS cash, 2000000.0::DOUBLE AS buying_power,
          {rq('sum(market_value) * 0.5', 2)} AS margin_used, 1000000.0::DOUBLE AS available_withdrawal, {rq('sum(market_value)', 2)} AS market_value
          FROM book""", **BOOK),
    ),
    Case(
        "positions_marked", "C13, H34",
        lambda t: rounded(t.positions.join(
            t.last_price.filter(F.col("symbol").cast("bigint") % 2 == 0), "symbol", "left").withColumn(
            "now", F.coalesce("price", "current_price")).filter("quantity <> 0").select(
            "symbol", "now", ft.market_value(F.col("quantity"), F.col("now")).alias("value"),
            ft.return_pct(F.col("quantity") > 0, F.col("avg_cost"), F.col("now")).alias("return_pct"),
            ft.unrealised(F.col("quantity") > 0, F.col("quantity"), F.col("avg_cost"), F.col("now")).alias("unrealised")), 4, now=9),
        sql(f"""SELECT symbol, {rq('now', 9)} AS now, {rq('abs(quantity) * now', 4)} AS value,
          {rq('CASE WHEN quantity > 0 THEN (now - avg_cost) / avg_cost ELSE (avg_cost - now) / avg_cost END', 4)} AS return_pct,
          {rq('CASE WHEN quantity > 0 THEN (now - avg_cost) * quantity ELSE (avg_cost - now) * abs(quantity) END', 4)} AS unrealised FROM (
          SELECT p.*, coalesce(l.price, current_price) AS now FROM positions p LEFT JOIN last_price l
          ON p.symbol = l.symbol AND CAST(l.symbol AS BIGINT) % 2 = 0) WHERE quantity <> 0"""),
    ),
    Case(
        "trade_costs", "K16, H35, H36, H37",
        lambda t: rounded(_costed(t).select(
            "symbol", "l_orderkey", "l_linenumber", "trade_id", "fill_price", "notional", "commission", "stamp_duty", "slippage", "total_cost"), 5),
        sql(f"""SELECT symbol, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, symbol || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS trade_id, {rq('fill_price', 5)} AS fill_price,
          {rq('notional', 5)} AS notional, {rq('commission', 5)} AS commission, {rq('stamp_duty', 5)} AS stamp_duty,
          {rq('abs(fill_price - price) * quantity', 5)} AS slippage, {rq('notional + commission + stamp_duty', 5)} AS total_cost FROM costed""", **FIFO),
    ),
    Case(
        "fill_prices_vwap", "H36",
        lambda t: rounded(t.fills.select("symbol", "l_orderkey", "l_linenumber", ft.fill_price(F.col("side"), F.col("price"), "vwap").alias("fill_price"))),
        sql(f"""SELECT symbol, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {rq('''CASE WHEN side = 'BUY' THEN price * 1.001::DOUBLE * 1.001::DOUBLE
          ELSE price * 0.999::DOUBLE * 0.999::DOUBLE END''')} AS fill_price FROM fills"""),
    ),
    Case(
        "exit_profit", "H38",
        lambda t: rounded(t.held.join(t.last_price, "symbol").select("symbol", ft.exit_pnl(
            F.col("entry_type") == "BUY", F.col("price"), F.col("entry_price"), F.lit(100), ft.commission(F.col("price") * 100)).alias("pnl")), 4),
        sql(f"""SELECT symbol, {rq('''CASE WHEN entry_type = 'BUY' THEN (price - entry_price) * 100 ELSE (entry_price - price) * 100 END
          - greatest(price * 100 * 0.0003, 5)''', 4)} AS pnl FROM held JOIN last_price USING (symbol)"""),
    ),
    Case(
        "trade_report", "A13",
        lambda t: rounded(store.trade_report(_costed(t).withColumn("source_signal", F.lit("ledger"))), 5),
        sql(f"""SELECT symbol || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS trade_id, symbol, side, quantity, {rq('price', 5)} AS price,
          strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, {rq('commission', 5)} AS commission, 'ledger' AS source_signal FROM costed""", **FIFO),
    ),
    Case(
        "trade_breakdown", "D19", lambda t: rounded(pp.trade_breakdown(_costed(t)), 2),
        sql(f"""SELECT count(*) AS total_trades, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells,
          {rq('sum(commission)', 2)} AS commission_total FROM costed""", **FIFO),
    ),
    Case(
        "round_trips", "C15, D16",
        lambda t: rounded(pp.round_trips(_costed(t), FILL_ORDER).select("symbol", "pair_no", "pnl", "trade_return"), 4),
        sql(f"SELECT symbol, pair_no, {rq('pnl', 4)} AS pnl, {rq('pnl / (buy_price * sell_quantity)', 4)} AS trade_return FROM pairs", **FIFO),
    ),
    Case(
        "trade_statistics", "D16, S6", lambda t: rounded(pp.trade_statistics(pp.round_trips(_costed(t), FILL_ORDER)), 4, gross_profit=2, gross_loss=2),
        sql(f"""SELECT n_pairs, wins, {rq('gross_profit', 2)} AS gross_profit, {rq('gross_loss', 2)} AS gross_loss, {rq('mean_win', 4)} AS mean_win,
          {rq('mean_loss', 4)} AS mean_loss, {rq('wins / n_pairs', 4)} AS win_rate, {rq('gross_profit / gross_loss', 4)} AS profit_factor,
          gross_loss = 0 AND gross_profit > 0 AS no_losses FROM stats""", **STATS),
    ),
    # --- equity -------------------------------------------------------------
    Case(
        "equity_drawdown", "E11",
        lambda t: rounded(with_drawdown(t.equity.withColumn("c", F.lit(0)), ["c"], ["date"], "equity", CAPITAL).drop("c"), 6, equity=2, peak=2),
        sql(f"SELECT {day('date')} AS date, {rq('equity', 2)} AS equity, {rq('peak', 2)} AS peak, {rq('drawdown')} AS drawdown FROM fallen", **DRAW),
    ),
    Case(
        "equity_daily_returns", "E12",
        lambda t: rounded(with_return(t.equity.withColumn("c", F.lit(0)), ["c"], ["date"], "equity").select("date", "ret"), 8),
        sql(f"""SELECT {day('date')} AS date, {rq('equity / lag(equity) OVER (ORDER BY equity.date) - 1', 8)} AS ret FROM equity"""),
    ),
    Case(
        "equity_until_stop", "E13",
        lambda t: rounded(cut_after_breach(
            with_drawdown(t.equity.withColumn("c", F.lit(0)), ["c"], ["date"], "equity", CAPITAL), ["c"], ["date"], 0.01).select("date", "drawdown")),
        sql(f"""SELECT {day('date')} AS date, {rq('drawdown')} AS drawdown FROM fallen
          WHERE fallen.date <= coalesce((SELECT min(f.date) FROM fallen f WHERE f.drawdown >= 0.01), DATE '9999-01-01')""", **DRAW),
    ),
    Case(
        "curve_measures", "D21", lambda t: rounded(pp.curve_measures(t.equity, CURVE, stop=False), 6, final_capital=2),
        sql(f"SELECT {MEASURES}, n_days FROM measures", **_curve_sql(None)),
    ),
    Case(
        "curve_measures_with_stop", "D21, E13",
        lambda t: rounded(pp.curve_measures(t.equity, CostParams(initial_capital=CAPITAL, drawdown_stop=0.01)), 6, final_capital=2),
        sql(f"SELECT {MEASURES}, n_days FROM measures", **_curve_sql(0.01)),
    ),
    Case(
        "performance_report", "K18, D16, D21",
        lambda t: rounded(pp.performance_report(t.equity, _costed(t), FILL_ORDER, CURVE), 6, final_capital=2, profit_factor=4),
        sql(f"""SELECT {MEASURES}, {rq('wins / n_pairs')} AS win_rate, (SELECT count(*) FROM costed) AS total_trades,
          {rq('gross_profit / gross_loss', 4)} AS profit_factor, false AS no_losses FROM measures CROSS JOIN stats""", **_curve_sql(0.20), **STATS),
    ),
    Case(
        "mark_to_market", "K17, C13, A13",
        lambda t: rounded(store.equity_report(pp.mark_to_market(_brand_trades(t), _hours(t), CAPITAL, FILL_ORDER, "hour")), 0),
        sql(f"""SELECT {day('day')} AS date, {rq('1e9 + sum(flow) OVER w + positions_value', 0)} AS equity, {rq('1e9 + sum(flow) OVER w', 0)} AS cash,
          {rq('positions_value', 0)} AS positions_value FROM daily_value WINDOW w AS (ORDER BY daily_value.day)""", **MARKED),
    ),
    # --- exits --------------------------------------------------------------
    Case(
        "first_touch_exits", "K19, C18", lambda t: rounded(pp.first_touch(_entries(t), t.bars), 6, entry_price=9),
        _touch_sql(MOMENTUM, "SELECT * FROM called WHERE signal_type IS NOT NULL", "SELECT symbol, day, close FROM bars", STOPS + " END"),
    ),
    Case(
        "first_touch_exits_with_reversal", "K19, H23",
        lambda t: rounded(pp.first_touch(_entries(t), _mood_bars(t)), 6, entry_price=9),
        _touch_sql(
            MOMENTUM, "SELECT * FROM called WHERE signal_type IS NOT NULL",
            "SELECT b.symbol, b.day, b.close, m.score AS mood FROM bars b ASOF LEFT JOIN brand_mood m ON b.symbol = m.symbol AND b.day >= m.day",
            STOPS + """ WHEN b.mood IS NULL THEN NULL WHEN e.signal_type = 'BUY' AND b.mood > 1 OR e.signal_type = 'SELL' AND b.mood < -1 THEN 'sentiment_reversal'
              WHEN e.signal_type = 'SELL' THEN 'valuation_reversal' END"""),
    ),
    # --- orders and risk ----------------------------------------------------
    Case(
        "request_faults", "H39",
        lambda t: t.requests.select("request_id", ft.request_fault(
            F.col("symbol"), F.col("quantity"), F.col("order_type"), F.col("price"), F.col("stop_price")).alias("fault")),
        sql("""SELECT request_id, CASE WHEN symbol = '' THEN 'invalid_symbol' WHEN quantity <= 0 THEN 'invalid_quantity'
          WHEN order_type IN ('limit', 'stop_limit') AND price IS NULL THEN 'limit_price_missing'
          WHEN order_type IN ('stop', 'stop_limit') AND stop_price IS NULL THEN 'stop_price_missing'
          WHEN price <= 0 THEN 'price_not_positive' WHEN stop_price <= 0 THEN 'stop_price_not_positive' END AS fault FROM requests"""),
    ),
    Case("order_screen", "K13, C14, D17", lambda t: _screen(t, WIDE, custom=True), _screen_sql(WIDE, 0.0, True)),
    Case("order_screen_defaults", "K13, D17", lambda t: _screen(t, RiskParams()), _screen_sql(RiskParams(), 0.0, False)),
    Case("order_screen_after_loss", "K13, K14", lambda t: _screen(t, WIDE, 6000.0), _screen_sql(WIDE, 6000.0, False)),
    Case(
        "exposure", "D17", lambda t: rounded(po.exposure(t.positions, t.last_price), 2),
        sql(f"""SELECT count(*) FILTER (quantity <> 0) AS n_open, {rq('sum(abs(quantity) * coalesce(price, 0))', 2)} AS value
          FROM positions LEFT JOIN last_price USING (symbol)"""),
    ),
    Case(
        "stop_loss_scan", "K14, H40", lambda t: rounded(po.stop_loss_scan(t.positions).select("symbol", "quantity", "current_price"), 9),
        sql(f"""SELECT symbol, quantity, {rq('current_price', 9)} AS current_price FROM positions WHERE quantity <> 0 AND
          CASE WHEN quantity > 0 THEN (current_price - avg_cost) / avg_cost * 100 ELSE (avg_cost - current_price) / avg_cost * 100 END <= -5"""),
    ),
    Case(
        "stop_loss_scan_fresh_prices", "K14, C13",
        lambda t: rounded(po.stop_loss_scan(t.positions, t.last_price.filter(F.col("symbol").cast("bigint") % 2 == 0)).select("symbol", "quantity", "current_price"), 9),
        sql(f"""SELECT symbol, quantity, {rq('now', 9)} AS current_price FROM (SELECT p.*, coalesce(l.price, current_price) AS now FROM positions p
          LEFT JOIN last_price l ON p.symbol = l.symbol AND CAST(l.symbol AS BIGINT) % 2 = 0) WHERE quantity <> 0 AND
          CASE WHEN quantity > 0 THEN (now - avg_cost) / avg_cost * 100 ELSE (avg_cost - now) / avg_cost * 100 END <= -5"""),
    ),
    Case(
        "daily_losses", "E21, K14",
        lambda t: rounded(po.close_all(po.daily_losses(t.read("events").select(
            F.col("user_id").alias("account"), "ts", (10000 + F.col("value") * 40).alias("balance"))))),
        sql(f"""SELECT user_id AS account, {day('d')} AS day, {rq('s')} AS start_balance, {rq('c')} AS current_balance, {rq('s - c')} AS daily_loss,
          s - c >= 5000 AS limit_reached FROM (SELECT user_id, CAST(ts AS DATE) AS d, arg_min(10000 + value * 40, ts) AS s,
          arg_max(10000 + value * 40, ts) AS c FROM events GROUP BY 1, 2)"""),
    ),
    Case(
        "risk_summary", "K14",
        lambda t: rounded(po.risk_summary(po.daily_losses(t.read("events").select(
            F.col("user_id").alias("account"), "ts", (10000 + F.col("value") * 40).alias("balance"))), _limits(t)).select(
            "account", "day", "daily_loss", "limit_reached", "max_positions", "custom_position_limits")),
        sql(f"""SELECT user_id AS account, {day('d')} AS day, {rq('s - c')} AS daily_loss, s - c >= 5000 AS limit_reached, 10::BIGINT AS max_positions,
          (SELECT count(*) FROM positions WHERE CAST(symbol AS BIGINT) % {BIG_LIMITS} = 0) AS custom_position_limits
          FROM (SELECT user_id, CAST(ts AS DATE) AS d, arg_min(10000 + value * 40, ts) AS s,
          arg_max(10000 + value * 40, ts) AS c FROM events GROUP BY 1, 2)"""),
    ),
    Case(
        "order_fills", "D14, B6",
        lambda t: rounded(po.order_fills(
            t.read("orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 200 + 1).alias("quantity")),
            t.fills.filter("l_orderkey % 7 <> 0").withColumnRenamed("l_orderkey", "order_id").select("order_id", "quantity", "price")), 5).withColumns({
            "active": ft.order_is_active(F.col("status")), "complete": ft.order_is_complete(F.col("status"))}),
        # the fills of every seventh order are left out, so that unfilled orders occur
        sql(f"""SELECT *, status <> 'filled' AS active, status = 'filled' AS complete FROM (
          SELECT o_orderkey AS order_id, o_orderkey % 200 + 1 AS quantity, coalesce(f, 0) AS filled_quantity, {rq('p', 5)} AS avg_fill_price,
          CASE WHEN f IS NULL THEN 'pending' WHEN f >= o_orderkey % 200 + 1 THEN 'filled' ELSE 'partially_filled' END AS status,
          o_orderkey % 200 + 1 - coalesce(f, 0) AS remaining_quantity FROM orders LEFT JOIN (
          SELECT l_orderkey, sum(quantity) AS f, sum(quantity * price) / sum(quantity) AS p FROM fills WHERE l_orderkey % 7 <> 0 GROUP BY 1)
          ON l_orderkey = o_orderkey)"""),
    ),
    Case(
        "requests_of_symbol", "B6", lambda t: po.requests_of(t.requests, "7").select("request_id", "side", "quantity"),
        sql("SELECT request_id, side, quantity FROM requests WHERE symbol = '7'"),
    ),
]
