"""The ledger operators with one symbol that owns a third of all rows, cut into segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentifold.operators import ledger
from sentifold.operators.asof import asof_join
from sentifold.operators.cooldown import accept_after_cooldown
from sentifold.operators.median import exact_medians
from sentifold.plans.mood import mood_by_observation
from sentifold.plans.scoring import popularity

from .case import Case, rounded, rq
from .tables import FILL_ORDER
from .views import sql

# A limit far below the size of the large symbol, so that these runs do cut it.
LIMIT = 2000


def _fills(t):
    big = F.col("symbol").cast("bigint") % 3 == 0
    order = [*FILL_ORDER, "part"]
    df = t.fills.withColumn("part", F.col("symbol").cast("bigint")).withColumn("symbol", F.when(big, "hot").otherwise(F.col("symbol")))
    return df, order


def _events(t):
    big = F.col("symbol").cast("bigint") % 3 == 0
    return t.sentiment_raw.withColumn("symbol", F.when(big, "hot").otherwise(F.col("symbol")))


def _asof(t):
    left = _events(t).withColumn("ts", F.expr("ts - interval 8400 days")).select("symbol", "ts", "event_id")
    right = _fills(t)[0].groupBy("symbol", "ts").agg(F.max("price").alias("price"))
    return asof_join(left, right, ["symbol"], "ts", "price", ["event_id"], True, LIMIT)


HOT = {
    "hot_fills": """SELECT CASE WHEN CAST(symbol AS BIGINT) % 3 = 0 THEN 'hot' ELSE symbol END AS symbol, CAST(symbol AS BIGINT) AS part,
      ts, l_orderkey, l_linenumber, side, qty, price FROM fills""",
    "hot_events": """SELECT CASE WHEN CAST(symbol AS BIGINT) % 3 = 0 THEN 'hot' ELSE symbol END AS symbol, ts, event_id FROM sentiment_raw""",
    "levels": """SELECT *, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS step, sum(CASE WHEN side = 'BUY' THEN 1 ELSE -1 END) OVER w AS s,
      row_number() OVER w AS n FROM hot_fills WINDOW w AS (PARTITION BY symbol ORDER BY ts, l_orderkey, l_linenumber, part ROWS UNBOUNDED PRECEDING)""",
    "lows": "SELECT *, min(s - step) OVER (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING) AS low FROM levels",
    "matched": """SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY n) AS pair_no FROM lows
      WHERE side = 'BUY' OR s - step > low""",
    "paired": """SELECT symbol, pair_no, max(CASE WHEN side = 'BUY' THEN {'o': l_orderkey, 'p': price} END) AS b,
      max(CASE WHEN side = 'SELL' THEN {'o': l_orderkey, 'p': price} END) AS s FROM matched GROUP BY symbol, pair_no""",
    # Average cost as a fold over each symbol's fills: quantity, cost, profit, profit since flat, last price, fills, fills that left a position.
    "folded": """SELECT symbol, list_reduce(list({'q': qty::DOUBLE, 'c': price, 'g': 0.0::DOUBLE, 'o': 0.0::DOUBLE, 'p': price, 'n': 1, 'k': 1}
        ORDER BY ts, l_orderkey, l_linenumber, part), lambda a, x: {
        'q': a.q + x.q,
        'c': CASE WHEN a.q = 0 THEN x.p WHEN sign(a.q) = sign(x.q) THEN (a.q * a.c + x.q * x.p) / (a.q + x.q)
          WHEN abs(x.q) > abs(a.q) THEN x.p ELSE a.c END,
        'g': a.g + CASE WHEN a.q <> 0 AND sign(a.q) <> sign(x.q) THEN (x.p - a.c) * least(abs(x.q), abs(a.q)) * sign(a.q) ELSE 0 END,
        'o': CASE WHEN a.q + x.q = 0 THEN 0 ELSE a.o + CASE WHEN a.q <> 0 AND sign(a.q) <> sign(x.q)
          THEN (x.p - a.c) * least(abs(x.q), abs(a.q)) * sign(a.q) ELSE 0 END END,
        'p': x.p, 'n': a.n + 1, 'k': a.k + CASE WHEN a.q + x.q <> 0 THEN 1 ELSE 0 END}) AS f FROM hot_fills GROUP BY symbol""",
}

CASES = [
    Case(
        "fifo_pairs_hot_symbol", "C15, E14",
        lambda t: rounded(ledger.fifo_pairs(*_fills(t)[:1], ["symbol"], _fills(t)[1], ["l_orderkey", "price"], LIMIT)),
        sql(f"""SELECT symbol, pair_no, b.o AS buy_l_orderkey, {rq('b.p')} AS buy_price, s.o AS sell_l_orderkey, {rq('s.p')} AS sell_price
          FROM paired WHERE b IS NOT NULL AND s IS NOT NULL""", **HOT),
    ),
    Case(
        "position_quantities_hot_symbol", "D15",
        lambda t: ledger.average_cost_book(*_fills(t)[:1], ["symbol"], _fills(t)[1], limit=LIMIT, fold=512).select("symbol", "quantity", "n_fills"),
        sql("SELECT symbol, CAST(sum(qty) AS BIGINT) AS quantity, count(*) AS n_fills FROM hot_fills GROUP BY symbol", **HOT),
    ),
    Case(
        "position_book_hot_symbol", "D15, K15",
        lambda t: rounded(ledger.average_cost_book(*_fills(t)[:1], ["symbol"], _fills(t)[1], limit=LIMIT, fold=512), 3),
        sql(f"""SELECT symbol, CAST(f.q AS BIGINT) AS quantity, {rq('CASE WHEN f.q <> 0 THEN f.c END', 3)} AS avg_cost, {rq('f.p', 3)} AS last_price,
          {rq('f.g', 3)} AS realised_all, {rq('f.o', 3)} AS realised_open, CAST(f.n AS BIGINT) AS n_fills FROM folded""", **HOT),
    ),
    Case(
        "fill_ledger_hot_symbol", "D15, K15",
        lambda t: rounded(ledger.cost_ledger(*_fills(t)[:1], ["symbol"], _fills(t)[1], limit=LIMIT, stretch=1500)
                          .groupBy("symbol").agg(F.sum("realised").alias("realised"), F.count("avg_cost_after").alias("n_open")), 2),
        sql(f"SELECT symbol, {rq('f.g', 2)} AS realised, CAST(f.k AS BIGINT) AS n_open FROM folded", **HOT),
    ),
    Case(
        "sentiment_by_observation_hot_symbol", "E1, E2, E3, E4, E5, K3",
        lambda t: rounded(mood_by_observation(
            _events(t).select("symbol", "ts", "event_id", (F.col("score") * 5).alias("total")), ["ts", "event_id"], limit=LIMIT // 2
        ).select("symbol", "event_id", "ema", "roc", "mean", "std", "z_score", "rows_seen", "is_extreme", "label"), 4),
        sql(f"""SELECT symbol, event_id, {rq('ema', 4)} AS ema, {rq('roc', 4)} AS roc, {rq('mean', 4)} AS mean, {rq('std', 4)} AS std,
          {rq('z', 4)} AS z_score, n AS rows_seen, CASE WHEN n < 10 THEN abs(ema) >= 2 ELSE abs(z) >= 1.5 END AS is_extreme,
          CASE WHEN ema <= -3 THEN 'extreme_bearish' WHEN ema <= -1.5 THEN 'bearish' WHEN ema >= 3 THEN 'extreme_bullish'
            WHEN ema >= 1.5 THEN 'bullish' ELSE 'neutral' END AS label FROM (
          SELECT *, coalesce(ema - lag(ema) OVER w, 0) AS roc, avg(ema) OVER a AS mean, stddev_pop(ema) OVER a AS std,
            CASE WHEN stddev_pop(ema) OVER b >= 0.01 THEN (ema - avg(ema) OVER b) / stddev_pop(ema) OVER b ELSE 0 END AS z FROM emas
          WINDOW w AS (PARTITION BY symbol ORDER BY n), a AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
            b AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING))""", **HOT,
            observed="""SELECT symbol, event_id, total, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS n FROM (
              SELECT h.symbol, h.ts, h.event_id, s.score * 5 AS total FROM hot_events h JOIN sentiment_raw s ON h.event_id = s.event_id)""",
            emas="""SELECT o.symbol, o.event_id, o.n, any_value(o.total) AS total, sum(CASE WHEN q.n = 1 THEN 1 ELSE 0.2 END * pow(0.8, o.n - q.n) * q.total) AS ema
              FROM observed o JOIN observed q ON q.symbol = o.symbol AND q.n <= o.n AND q.n > o.n - 250 GROUP BY o.symbol, o.event_id, o.n"""),
    ),
    Case(
        "cooled_signals_hot_symbol", "E22",
        lambda t: accept_after_cooldown(_events(t).select("symbol", "ts", "event_id"), ["symbol"], "ts", ["event_id"], 720, LIMIT // 8)
        .filter("accepted").select("symbol", "event_id"),
        sql("""SELECT symbol, event_id FROM chain""", **HOT,
            chain="""SELECT symbol, arg_min(event_id, ts) AS event_id, min(ts) AS ts FROM hot_events GROUP BY symbol UNION ALL
              SELECT c.symbol, arg_min(e.event_id, e.ts), min(e.ts) FROM chain c JOIN hot_events e
              ON e.symbol = c.symbol AND e.ts >= c.ts + INTERVAL 720 MINUTES GROUP BY c.symbol"""),
    ),
    Case(
        "events_with_fill_as_of_hot_symbol", "C17", lambda t: rounded(_asof(t).select("symbol", "event_id", "price")),
        sql(f"""SELECT e.symbol, e.event_id, {rq('f.price')} AS price
          FROM (SELECT symbol, ts - INTERVAL 8400 DAYS AS ts, event_id FROM hot_events) e
          ASOF LEFT JOIN (SELECT symbol, ts, max(price) AS price FROM hot_fills GROUP BY symbol, ts) f
          ON e.symbol = f.symbol AND e.ts >= f.ts""", **HOT),
    ),
    Case(
        "medians_hot_sector", "D20",
        lambda t: rounded(exact_medians(_fills(t)[0].select("symbol", "price"), "symbol", ["price"], LIMIT).withColumnRenamed("price", "median_price")),
        sql(f"SELECT symbol, {rq('median(price)')} AS median_price FROM hot_fills GROUP BY symbol", **HOT),
    ),
    Case(
        "popularity_long_ranking", "E15", lambda t: rounded(popularity(t.vendor()["hot_rank"], limit=200), 9),
        sql(f"SELECT raw_symbol, CAST(substr(raw_symbol, 3) AS BIGINT) AS rank, {rq('pct', 9)} AS popularity FROM social"),
    ),
]
