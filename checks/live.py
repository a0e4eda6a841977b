"""Streams over the given tables, and rules from the design text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sentifold.operators.durable import shared_folder
from sentifold.operators.series import with_return
from sentifold.params import RouterParams
from sentifold.plans import correlation, rules
from sentifold.plans import routing as pr
from sentifold.sources.store import read_snapshot
from sentifold.streaming import live

from .case import Case, day, rounded, rq, stamp
from .signals import EVENT_TIMES, RETURNS, ROUTE_BODY, WEIGHTS, _routed_views
from .tables import SCHEMAS
from .views import sql


# Pairs of symbols whose returns of the latest days correlate; a day without a return counts as unchanged.
PAIR_DAYS, PAIR_LIMIT = 250, 0.05
PAIRED = {
    **RETURNS,
    "latest_days": f"SELECT DISTINCT day FROM bars ORDER BY day DESC LIMIT {PAIR_DAYS}",
    "inside": "SELECT symbol, day, ret FROM returns JOIN latest_days USING (day) WHERE ret IS NOT NULL",
    "filled": """SELECT e.symbol, e.day, coalesce(i.ret, 0) AS ret FROM (SELECT symbol, day FROM latest_days,
      (SELECT symbol FROM inside GROUP BY symbol HAVING count(*) >= 20)) e LEFT JOIN inside i ON i.symbol = e.symbol AND i.day = e.day""",
    "paired": f"""SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, corr(a.ret, b.ret) AS c FROM filled a JOIN filled b
      ON a.day = b.day AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol HAVING corr(a.ret, b.ret) > {PAIR_LIMIT}""",
}


def _pairs(t):
    return correlation.correlated_pairs(t.bars.select("symbol", "day", "close"), t.bars.select("symbol").distinct(), PAIR_LIMIT, PAIR_DAYS)


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


# Rows of a landed file, whose number follows the table, and the most files that one micro-batch takes.
FILE_ROWS, BATCH_FILES = 250_000, 8


def _stream(t, table: str, order=None, files: int = 4):
    """A table as a stream of ``files`` micro-batches or more: landed in the order of a column, or in any order."""
    folder, df = f"{_folder(t)}/landed", t.read(table)
    n = max(files, -(-df.count() // FILE_ROWS))
    (df.repartition(n) if order is None else df.repartitionByRange(n, order)).write.parquet(folder)
    # File times decide the order of a file stream; the numbered names follow the ranges.
    jvm = t.spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(t.spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(path))
    for k, name in enumerate(x for x in names if x.startswith("part-")):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(folder, name), 1_700_000_000_000 + 1000 * k, -1)
    return t.spark.readStream.schema(SCHEMAS[table]).option("maxFilesPerTrigger", min(n // files, BATCH_FILES)).parquet(folder)


# Minutes that scores and signals wait for older ones.
HOLD = 1440


def _delayed(t):
    """Events that land up to a day after their time, by a rule of their number."""
    return _events(t, F.expr(f"ts + make_interval(0, 0, 0, 0, 0, event_id * 7919 % {HOLD}, 0)"), 8)


def _events(t, order=None, files: int = 4):
    return _stream(t, "events", F.col("ts") if order is None else order, files).select(
        F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("tie"), "event_type", "value",
    )


def _drain(t, stream):
    folder = _folder(t)
    return live.drain(stream, f"{folder}/rows", f"{folder}/state")


def _mood(t, events=None, hold: int = 0):
    # Two steps: a quotient and a difference in the order the SQL side has them.
    score = F.greatest(F.least(1 - F.col("value") / 50, F.lit(1.0)), F.lit(-1.0))
    scores = (_events(t) if events is None else events).select("symbol", "ts", "tie", (score * 5).alias("total"))
    rows = _drain(t, live.live_mood(scores, hold_minutes=hold)).filter("not late")
    return rounded(rows.select(F.col("tie").alias("event_id"), "symbol", "total", "ema", "roc", "rows_seen", "is_extreme"), 5)


def _cooled(t, events=None, hold: int = 0):
    signals = (_events(t) if events is None else events).select("symbol", "ts", "tie")
    return _drain(t, live.live_cooldown(signals, 1440, hold)).filter("not late").select("symbol", F.col("tie").alias("event_id"))


def _mood_sql(due: str = "true") -> str:
    return sql(
        f"""SELECT event_id, symbol, {rq('total', 5)} AS total, {rq('ema', 5)} AS ema, {rq('ema - coalesce(before, ema)', 5)} AS roc, n AS rows_seen,
          CASE WHEN n < 10 THEN abs(ema) >= 2 ELSE coalesce(abs((ema - m) / CASE WHEN s >= 0.01 THEN s END), 0) >= 1.5 END AS is_extreme FROM (
          SELECT *, lag(ema) OVER w AS before, avg(ema) OVER p AS m, stddev_pop(ema) OVER p AS s FROM walk
          WINDOW w AS (PARTITION BY symbol ORDER BY n), p AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING)) WHERE {due}""",
        numbered="SELECT symbol, event_id, ts, score * 5 AS total, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS n FROM sentiment_raw",
        walk="""SELECT symbol, n, event_id, ts, total, total AS ema FROM numbered WHERE n = 1 UNION ALL
            SELECT o.symbol, o.n, o.event_id, o.ts, o.total, 0.2 * o.total + 0.8 * w.ema FROM walk w JOIN numbered o ON o.symbol = w.symbol AND o.n = w.n + 1""",
    )


def _cooled_sql(due: str = "true") -> str:
    return sql(
        f"SELECT symbol, event_id FROM walk WHERE accepted AND {due}", ordered=EVENT_TIMES,
        walk="""SELECT symbol, n, event_id, ts, ts AS last_ts, true AS accepted FROM ordered WHERE n = 1 UNION ALL
              SELECT o.symbol, o.n, o.event_id, o.ts, CASE WHEN o.ts >= w.last_ts + INTERVAL 1440 MINUTES THEN o.ts ELSE w.last_ts END,
              o.ts >= w.last_ts + INTERVAL 1440 MINUTES FROM walk w JOIN ordered o ON o.symbol = w.symbol AND o.n = w.n + 1""",
    )


# What the watermark has passed when the stream ends; it counts in milliseconds.
DUE = f"date_trunc('milliseconds', ts) <= (SELECT date_trunc('milliseconds', max(ts)) FROM sentiment_raw) - INTERVAL {HOLD} MINUTES"


def _position_changes(t):
    folder = _folder(t)
    changes = _events(t).select(
        "symbol", "ts", (F.col("tie") % 100).alias("quantity"), F.col("value").alias("entry_price"),
        (F.col("tie") % 7 == 0).alias("closed"),
    )
    live.drain_batches(changes, live.position_writer(f"{folder}/positions"), f"{folder}/state")
    return read_snapshot(t.spark, f"{folder}/positions").select("symbol", "quantity", "entry_price")


def _prices(t):
    return _stream(t, "lineitem").select(
        F.col("l_partkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
    )


INDEX = "SELECT day, CAST(sum(amount) AS DOUBLE) / sum(volume) AS close FROM bars GROUP BY day"


def _index(t):
    return t.bars.groupBy("day").agg((F.sum("amount") / F.sum("volume")).alias("close"))


def _routed(t):
    return pr.route(t.signals, WEIGHTS, RouterParams(), ["run"])


ENTRY = "signal_type IN ('BUY', 'SELL')"

CASES = [
    Case("stream_mood", "I1", _mood, _mood_sql()),
    Case("stream_mood_held", "I1", lambda t: _mood(t, _delayed(t), HOLD), _mood_sql(DUE)),
    Case(
        "stream_positions", "I2, A15", lambda t: rounded(_position_changes(t)),
        f"""SELECT CAST(user_id AS VARCHAR) AS symbol, event_id % 100 AS quantity, {rq('value')} AS entry_price FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1 AND event_id % 7 <> 0""",
    ),
    Case(
        "stream_scores_with_positions", "I2",
        lambda t: rounded(_drain(t, live.enrich_with_positions(
            _events(t).select("symbol", "tie", "value"), t.positions.select("symbol", "quantity").withColumn("held", F.lit(True))))
            .select(F.col("tie").alias("event_id"), "value", F.coalesce("quantity", F.lit(0)).alias("quantity"), F.coalesce("held", F.lit(False)).alias("held"))),
        sql(f"""SELECT event_id, {rq('value')} AS value, coalesce(quantity, 0) AS quantity, p.symbol IS NOT NULL AS held
          FROM events LEFT JOIN positions p ON p.symbol = CAST(user_id AS VARCHAR)"""),
    ),
    Case(
        "stream_bars", "I3",
        lambda t: rounded(_drain(t, live.unique_bars(_prices(t).select("symbol", "ts"))).select("symbol", "ts")),
        sql(f"SELECT DISTINCT symbol, {stamp()} AS ts FROM fills"),
    ),
    Case(
        "stream_bars_of_symbols", "I3",
        lambda t: rounded(_drain(t, live.unique_bars_of_symbols(_prices(t).select("symbol", "ts"))).select("symbol", "ts")),
        sql(f"SELECT DISTINCT symbol, {stamp()} AS ts FROM fills"),
    ),
    Case(
        "stream_stop_loss", "I4",
        lambda t: rounded(_drain(t, live.live_stop_loss(_prices(t), t.positions)).select("symbol", "l_orderkey", "l_linenumber", "price"), 9),
        sql(f"""SELECT symbol, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {rq('price', 9)} AS price FROM fills JOIN positions p USING (symbol)
          WHERE p.quantity <> 0 AND CASE WHEN p.quantity > 0 THEN (price - avg_cost) / avg_cost * 100 ELSE (avg_cost - price) / avg_cost * 100 END <= -5"""),
    ),
    Case("stream_cooldown", "I5", _cooled, _cooled_sql()),
    Case("stream_cooldown_held", "I5", lambda t: _cooled(t, _delayed(t), HOLD), _cooled_sql(DUE)),
    # --- rules --------------------------------------------------------------
    Case(
        "sector_capped", "S1",
        lambda t: rounded(rules.cap_sectors(_routed(t), t.fundamentals, 0.02, ["run"]).select("run", "symbol", "sector", "position_size")),
        sql(f"""SELECT {day('run')} AS run, symbol, sector, {rq(f'position_size * CASE WHEN {ENTRY} AND total > 0.02 THEN 0.02 / total ELSE 1 END')} AS position_size
          FROM (SELECT s.run, s.symbol, f.sector, s.signal_type, s.position_size,
            sum(CASE WHEN s.{ENTRY} THEN s.position_size ELSE 0 END) OVER (PARTITION BY s.run, f.sector) AS total
            FROM scaled s JOIN fundamentals f ON f.symbol = s.symbol)""", **_routed_views()),
    ),
    Case(
        "side_capped", "S5",
        lambda t: rounded(rules.cap_sides(_routed(t), 0.3, 0.1, ["run"]).select("run", "symbol", "signal_type", "source", "strength", "confidence", "position_size")),
        sql(ROUTE_BODY.replace("FROM scaled", "FROM capped"), **_routed_views(),
            capped="""SELECT * REPLACE (position_size * CASE WHEN total > lim THEN lim / total ELSE 1 END AS position_size) FROM (
              SELECT * EXCLUDE (total), CASE signal_type WHEN 'BUY' THEN 0.3 WHEN 'SELL' THEN 0.1 END::DOUBLE AS lim,
              sum(position_size) OVER (PARTITION BY run, signal_type) AS total FROM scaled)"""),
    ),
    Case(
        "crowded_symbols", "S2",
        lambda t: rounded(rules.crowded_symbols(
            t.bars.select("symbol", "day", "close"), t.bars.select("symbol").distinct(), -0.02), 5),
        sql(f"""SELECT symbol, n_days, {rq('c', 5)} AS correlation FROM (SELECT symbol, count(*) AS n_days, corr(ret, others) AS c FROM (
          SELECT symbol, ret, (sum(ret) OVER (PARTITION BY day) - ret) / nullif(count(*) OVER (PARTITION BY day) - 1, 0) AS others
          FROM returns WHERE ret IS NOT NULL) WHERE others IS NOT NULL GROUP BY symbol) WHERE n_days >= 20 AND c > -0.02""", **RETURNS),
    ),
    Case(
        "correlated_pairs", "S2", lambda t: rounded(_pairs(t), 5),
        sql(f"SELECT symbol_a, symbol_b, {rq('c', 5)} AS correlation FROM paired", **PAIRED),
    ),
    Case(
        "uncorrelated_symbols", "S2",
        lambda t: rounded(correlation.uncorrelated(t.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars")), _pairs(t), "n_bars")),
        sql("""SELECT symbol, n_bars FROM candidates JOIN (WITH RECURSIVE walk AS (
            SELECT 0 AS i, CAST([] AS VARCHAR[]) AS stay
            UNION ALL SELECT i + 1, CASE WHEN list_has_any(stay, partners) THEN stay ELSE list_append(stay, symbol) END
            FROM walk JOIN candidates ON place = i + 1)
          SELECT unnest(stay) AS symbol FROM (SELECT stay FROM walk ORDER BY i DESC LIMIT 1)) USING (symbol)""", **PAIRED,
            candidates="""SELECT symbol, n_bars, row_number() OVER (ORDER BY n_bars DESC, symbol) AS place, coalesce(partners, CAST([] AS VARCHAR[])) AS partners
              FROM (SELECT symbol, count(*) AS n_bars FROM bars GROUP BY symbol) LEFT JOIN (SELECT symbol, list(other) AS partners FROM (
                SELECT symbol_a AS symbol, symbol_b AS other FROM paired UNION ALL SELECT symbol_b, symbol_a FROM paired) GROUP BY symbol) USING (symbol)"""),
    ),
    Case(
        "liquid_bars", "S3",
        lambda t: rounded(rules.liquid(t.bars, 60000.0).select("symbol", "day", "turnover"), 4),
        sql(f"""SELECT symbol, {day()} AS day, {rq('turnover', 4)} AS turnover FROM (SELECT symbol, day,
          avg(amount) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS turnover FROM bars) WHERE turnover >= 60000"""),
    ),
    Case(
        "market_regime", "S4",
        lambda t: rounded(rules.market_regime(_index(t)).select("day", "mean", "regime"), 4),
        sql(f"""SELECT {day()} AS day, {rq('mean', 4)} AS mean, CASE WHEN close < mean THEN 'bear' WHEN close >= mean THEN 'bull' END AS regime FROM (
          SELECT day, close, CASE WHEN count(*) OVER w >= 200 THEN avg(close) OVER w END AS mean FROM ({INDEX})
          WINDOW w AS (ORDER BY day ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))"""),
    ),
    Case(
        "signals_in_regime", "S4",
        lambda t: rounded(rules.allowed_in_regime(
            t.bars.select("symbol", "day", F.when(F.col("close") > F.col("open"), "BUY").otherwise("SELL").alias("signal_type")),
            rules.market_regime(_index(t))).select("symbol", "day", "signal_type")),
        sql(f"""SELECT b.symbol, {day('b.day')} AS day, CASE WHEN b.close > b.open THEN 'BUY' ELSE 'SELL' END AS signal_type
          FROM bars b JOIN regime r ON r.day = b.day WHERE NOT (b.close <= b.open AND coalesce(r.close < r.mean, false))""",
          regime=f"""SELECT day, close, CASE WHEN count(*) OVER w >= 200 THEN avg(close) OVER w END AS mean FROM ({INDEX})
          WINDOW w AS (ORDER BY day ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)"""),
    ),
    Case(
        "alpha_against_index", "S6",
        lambda t: rounded(rules.alpha_beta(
            with_return(t.equity.withColumn("c", F.lit(0)), ["c"], ["date"], "equity"),
            with_return(_index(t).withColumn("c", F.lit(0)).withColumnRenamed("day", "date"), ["c"], ["date"]))),
        sql(f"""SELECT {rq('regr_intercept(y, x)')} AS alpha, {rq('regr_slope(y, x)')} AS beta, count(*) AS n_days FROM (
          SELECT e.date, e.r AS y, i.r AS x FROM (SELECT date, equity / lag(equity) OVER (ORDER BY date) - 1 AS r FROM equity) e
          JOIN (SELECT day, close / lag(close) OVER (ORDER BY day) - 1 AS r FROM ({INDEX})) i ON i.day = e.date) WHERE x IS NOT NULL AND y IS NOT NULL"""),
    ),
    Case(
        "zscores_rolling", "S8", lambda t: rounded(rules.zscore_modes(t.bars.select("symbol", "day", "close"), "close").filter("z_score is not null").select("symbol", "day", "z_score"), 5),
        sql(f"""SELECT symbol, {day()} AS day, {rq('(close - m) / s', 5)} AS z_score FROM (SELECT symbol, day, close, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s,
          count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE n >= 20"""),
    ),
    Case(
        "zscores_expanding", "S8", lambda t: rounded(rules.zscore_modes(t.bars.select("symbol", "day", "close"), "close", "expanding").filter("z_score is not null").select("symbol", "day", "z_score"), 5),
        sql(f"""SELECT symbol, {day()} AS day, {rq('(close - m) / s', 5)} AS z_score FROM (SELECT symbol, day, close, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s,
          count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)) WHERE n >= 2 AND s > 0"""),
    ),
    Case(
        "zscores_ewma", "S8", lambda t: rounded(rules.zscore_modes(t.bars.select("symbol", "day", "close"), "close", "ewma").filter("z_score is not null").select("symbol", "day", "z_score"), 4),
        sql(f"""SELECT symbol, {day()} AS day, {rq('(close - m) / sqrt(m2 - m * m)', 4)} AS z_score FROM walk WHERE n > 1""",
            ordered="SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM bars",
            walk="""SELECT symbol, n, day, close, close AS m, close * close AS m2 FROM ordered WHERE n = 1 UNION ALL
              SELECT o.symbol, o.n, o.day, o.close, o.close * (2.0::DOUBLE / 21) + w.m * (1 - 2.0::DOUBLE / 21),
              o.close * o.close * (2.0::DOUBLE / 21) + w.m2 * (1 - 2.0::DOUBLE / 21) FROM walk w JOIN ordered o ON o.symbol = w.symbol AND o.n = w.n + 1"""),
    ),
]
