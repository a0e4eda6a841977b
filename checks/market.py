"""Reads, the store, filters and lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sentifold.functions import mood as fm
from sentifold.functions import trading as ft
from sentifold.functions.basic import id_text, order_id_text, usable_symbol
from sentifold.operators.asof import asof_join, value_as_of
from sentifold.operators.durable import shared_folder
from sentifold.params import SOURCE_WEIGHTS
from sentifold.sources import market, store, vendor

from .case import Case, day, rounded, rq, stamp
from .views import sql

# Prices are short decimals; with nine digits no rounding tie arises.
PRICE = 9
BRANDS = ["Brand#1", "Brand#7", "Brand#13"]
IN_BRANDS = "symbol IN ('Brand#1', 'Brand#7', 'Brand#13')"
BAR_COLS = (
    f"symbol, {day()} AS day, {rq('open', 9)} AS open, {rq('high', 9)} AS high, {rq('low', 9)} AS low, "
    f"{rq('close', 9)} AS close, {rq('volume')} AS volume, {rq('amount', 2)} AS amount"
)
_bars = lambda df: rounded(df, PRICE, amount=2)
D = lambda text: F.lit(text).cast("date")
TS = lambda text: F.lit(text).cast("timestamp_ntz")

CASES = [
    Case(
        "bars_between", "A1",
        lambda t: _bars(market.bars_between(t.bars, BRANDS, D("1997-03-01"), D("1998-03-01"), "day")),
        sql(f"SELECT {BAR_COLS} FROM bars WHERE {IN_BRANDS} AND day BETWEEN DATE '1997-03-01' AND DATE '1998-03-01'"),
    ),
    Case(
        "bars_of_symbol", "A2",
        lambda t: _bars(market.bars_of(t.bars, "Brand#5", D("1996-01-01"), D("2000-12-31"), "day")),
        sql(f"SELECT {BAR_COLS} FROM bars WHERE symbol = 'Brand#5' AND day BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"),
    ),
    Case(
        "bars_in_time_order", "A3", lambda t: _bars(market.in_time_order(t.bars, "day")),
        sql(f"SELECT {BAR_COLS} FROM bars ORDER BY bars.day, symbol"),
    ),
    Case(
        "fundamentals_as_of", "A4",
        lambda t: rounded(market.fundamentals_as_of(t.reports, as_of=TS("2000-10-15")).select(
            "symbol", F.to_date("ts").alias("day"), "pe_ratio", "pb_ratio")),
        sql(f"""SELECT symbol, {day()} AS day, {rq('pe_ratio')} AS pe_ratio, {rq('pb_ratio')} AS pb_ratio FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM reports
          WHERE day <= DATE '2000-10-15') WHERE rn = 1"""),
    ),
    Case(
        "sentiment_history", "A5",
        lambda t: rounded(store.history(
            t.sentiment_raw, t.names.select("symbol"), TS("2024-01-05"), TS("2024-01-20"), "news")),
        sql(f"""SELECT symbol, {stamp()} AS ts, event_id, source, {rq('score')} AS score, {rq('confidence')} AS confidence
          FROM sentiment_raw WHERE symbol IN (SELECT symbol FROM names) AND source = 'news'
          AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"""),
    ),
    Case(
        "packed_observations", "A6, H42",
        lambda t: rounded(store.unpack_raw(store.raw_from_json(store.raw_to_json(store.pack_raw(
            t.sentiment_raw.withColumns({
                "raw_score": F.col("score"), "sample_size": F.col("event_id") % 9,
                "metadata": F.when(F.col("event_id") % 4 != 0, F.create_map(F.lit("k"), F.col("source")))}))))).select(
            "symbol", "ts", "source", "score", "raw_score", "sample_size",
            F.col("metadata")["k"].alias("k"), F.size("metadata").cast("bigint").alias("n_meta"))),
        sql(f"""SELECT symbol, {stamp()} AS ts, source, {rq('score')} AS score, {rq('score')} AS raw_score, event_id % 9 AS sample_size,
          CASE WHEN event_id % 4 <> 0 THEN source END AS k, CAST(event_id % 4 <> 0 AS BIGINT) AS n_meta FROM sentiment_raw"""),
    ),
    Case(
        "composite_upsert", "A7",
        lambda t: rounded(store.merge_newest(
            t.composite.filter(F.col("day") <= D("2024-01-18")).select("symbol", "day", "score", "confidence"),
            t.composite.filter(F.col("day") >= D("2024-01-12")).select(
                "symbol", "day", (F.col("score") / 2).alias("score"), "confidence"),
            ["symbol", "day"])),
        sql(f"""SELECT symbol, {day()} AS day, {rq("CASE WHEN day >= DATE '2024-01-12' THEN score / 2 ELSE score END")} AS score,
          {rq('confidence')} AS confidence FROM composite"""),
    ),
    Case(
        "names_upsert", "A8",
        lambda t: store.merge_newest(
            t.names, t.fundamentals.filter(F.col("symbol").cast("bigint") % 4 == 0).select(
                "symbol", F.concat(F.lit("new "), "symbol").alias("name")), ["symbol"]),
        sql("""SELECT coalesce(f.symbol, n.symbol) AS symbol, coalesce('new ' || f.symbol, n.name) AS name
          FROM names n FULL JOIN (SELECT symbol FROM fundamentals WHERE CAST(symbol AS BIGINT) % 4 = 0) f ON f.symbol = n.symbol"""),
    ),
    Case(
        "names_lookup", "A9", lambda t: store.names_of(t.names, t.sentiment_raw),
        sql("SELECT symbol, name FROM names WHERE symbol IN (SELECT symbol FROM sentiment_raw)"),
    ),
    Case(
        "names_all", "A9", lambda t: store.all_names(t.names), sql("SELECT symbol, name FROM names"),
    ),
    Case(
        "names_missing", "C10", lambda t: store.without_name(t.sentiment_raw, t.names),
        sql("SELECT DISTINCT symbol FROM sentiment_raw WHERE symbol NOT IN (SELECT symbol FROM names)"),
    ),
    Case(
        "retention_kept", "A10",
        lambda t: rounded(store.keep_recent(t.sentiment_raw, TS("2024-01-31"), 12)),
        sql(f"""SELECT symbol, {stamp()} AS ts, event_id, source, {rq('score')} AS score, {rq('confidence')} AS confidence
          FROM sentiment_raw WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 12 DAYS"""),
    ),
    Case(
        "retention_report", "A10",
        lambda t: store.retention_report(t.sentiment_raw, TS("2024-01-31"), 12),
        sql("""SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-31' - INTERVAL 12 DAYS) AS removed,
          count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 12 DAYS) AS kept FROM sentiment_raw"""),
    ),
    Case(
        "margin_union", "A11, H12",
        lambda t: rounded(vendor.margin_table(t.vendor()["margin_a"], t.vendor()["margin_b"])),
        sql(f"SELECT code AS symbol, {rq('balance')} AS balance FROM margin"),
    ),
    Case(
        "universe_members", "A12",
        lambda t: market.universe(
            t.read("part").select(F.col("p_type").alias("universe"), F.col("p_partkey").cast("string").alias("symbol")),
            "SMALL"),
        "SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS symbol FROM part WHERE p_type = 'SMALL'",
    ),
    Case(
        "vendor_spot", "A16, B1",
        lambda t: rounded(vendor.spot_table(t.vendor()["spot"])),
        sql(f"SELECT code AS symbol, {rq('change_pct')} AS change_pct, {rq('volume')} AS volume FROM spot"),
    ),
    Case(
        "vendor_northbound", "A16, H12",
        lambda t: rounded(vendor.northbound_table(t.vendor()["northbound"])),
        f"""SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS symbol,
          {rq('CAST(p_partkey % 13 - 6 AS DOUBLE) / 100')} AS holding_change FROM part WHERE p_partkey % 5 <> 0""",
    ),
    Case(
        "code_name_list", "A17",
        lambda t: vendor.name_table(t.read("part").select(
            F.when(F.col("p_partkey") % 6 != 0, F.col("p_partkey")).alias("code"),
            F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("name"))),
        """SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_name AS name FROM part
          WHERE p_partkey % 6 <> 0 AND p_partkey % 7 <> 0""",
    ),
    Case(
        "position_snapshot", "A15", lambda t: _snapshot(t),
        sql(f"""SELECT symbol, entry_type, {rq('entry_price', 9)} AS entry_price, {rq('stop_loss', 9)} AS stop_loss,
          {rq('take_profit', 9)} AS take_profit FROM held"""),
    ),
    # --- filters ------------------------------------------------------------
    Case(
        "usable_symbols", "B1",
        lambda t: rounded(t.sentiment_raw.withColumn("symbol", F.when(F.col("event_id") % 5 == 0, "").when(
            F.col("event_id") % 7 == 0, "nan").when(F.col("event_id") % 11 != 0, F.col("symbol"))).filter(
            usable_symbol(F.col("symbol"))).select("event_id", "symbol")),
        sql("""SELECT event_id, symbol FROM sentiment_raw
          WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0"""),
    ),
    Case(
        "known_sources", "B2",
        lambda t: store.known_sources(t.sentiment_raw, list(SOURCE_WEIGHTS)).select("event_id", "source"),
        sql("SELECT event_id, source FROM sentiment_raw WHERE source <> 'other'"),
    ),
    Case(
        "confidence_rejects", "B10",
        lambda t: rounded(store.split_by_confidence(
            t.sentiment_raw.withColumn("confidence", F.col("confidence") * 1.2))[1].select("event_id", "confidence")),
        sql(f"SELECT event_id, {rq('confidence * 1.2')} AS confidence FROM sentiment_raw WHERE confidence * 1.2 > 1"),
    ),
    Case(
        "source_counts", "D7", lambda t: store.source_counts(t.sentiment_raw),
        sql("SELECT source, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols FROM sentiment_raw GROUP BY source"),
    ),
    Case(
        "trading_dates", "D18", lambda t: rounded(market.trading_dates(t.bars)),
        sql(f"SELECT DISTINCT {day()} AS day FROM bars"),
    ),
    Case(
        "sentiment_symbols", "D18", lambda t: market.symbols_of(t.sentiment_raw),
        sql("SELECT DISTINCT symbol FROM sentiment_raw"),
    ),
    Case(
        "latest_time", "D6",
        lambda t: rounded(market.latest_time(t.sentiment_raw)),
        sql(f"SELECT symbol, {stamp('max(ts)')} AS ts FROM sentiment_raw GROUP BY symbol"),
    ),
    Case(
        "latest_raw", "E19",
        lambda t: rounded(store.latest_raw(t.sentiment_raw)),
        sql(f"""SELECT symbol, {stamp()} AS ts, event_id, source, {rq('score')} AS score, {rq('confidence')} AS confidence FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, source DESC, score DESC) AS rn
          FROM sentiment_raw) WHERE rn = 1"""),
    ),
    Case(
        "latest_composite", "E19",
        lambda t: rounded(store.latest_composite(t.composite.select("symbol", "day", "score", "n_sources"), "day")),
        sql(f"""SELECT symbol, {day()} AS day, {rq('score')} AS score, n_sources FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM composite) WHERE rn = 1"""),
    ),
    Case(
        "daily_closes", "S7",
        lambda t: rounded(market.daily_closes(t.fills.groupBy("symbol", "ts").agg(F.max("price").alias("close"))), PRICE),
        sql(f"SELECT symbol, {day()} AS day, {rq('max(price)', 9)} AS close FROM fills GROUP BY symbol, fills.day"),
    ),
    Case(
        "latest_prices", "E19", lambda t: rounded(market.latest_prices(t.bars, "day")),
        sql(f"""SELECT symbol, {rq('close')} AS price FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM bars) WHERE rn = 1"""),
    ),
    # --- as-of --------------------------------------------------------------
    Case(
        "close_as_of", "C17",
        lambda t: rounded(value_as_of(t.bars, ["symbol"], "day", "close", D("1999-06-15"))),
        sql(f"""SELECT symbol, {rq('close')} AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn
          FROM bars WHERE day <= DATE '1999-06-15') WHERE rn = 1"""),
    ),
    Case(
        "bars_with_mood_as_of", "C17",
        lambda t: rounded(asof_join(
            t.bars.select("symbol", "day", "close"), t.brand_mood, ["symbol"], "day", "score")),
        sql(f"""SELECT b.symbol, {day('b.day')} AS day, {rq('b.close')} AS close, {rq('m.score')} AS score
          FROM bars b ASOF LEFT JOIN brand_mood m ON b.symbol = m.symbol AND b.day >= m.day"""),
    ),
    Case(
        "events_with_fill_as_of", "C17",
        lambda t: rounded(asof_join(
            t.sentiment_raw.withColumn("ts", F.expr("ts - interval 8400 days")).select("symbol", "ts", "event_id"),
            t.fills.groupBy("symbol", "ts").agg(F.max("price").alias("price")),
            ["symbol"], "ts", "price", ["event_id"], True).select("symbol", "event_id", "price")),
        sql(f"""SELECT e.symbol, e.event_id, {rq('f.price')} AS price
          FROM (SELECT symbol, ts - INTERVAL 8400 DAYS AS ts, event_id FROM sentiment_raw) e
          ASOF LEFT JOIN (SELECT symbol, ts, max(price) AS price FROM fills GROUP BY symbol, ts) f
          ON e.symbol = f.symbol AND e.ts >= f.ts"""),
    ),
    # --- plain formulas over bars and scores --------------------------------
    Case(
        "bar_features", "H33",
        lambda t: rounded(t.bars.select(
            "symbol", "day", ft.typical_price(F.col("high"), F.col("low"), F.col("close")).alias("typical"),
            ft.bar_range(F.col("high"), F.col("low")).alias("range"), ft.body_size(F.col("open"), F.col("close")).alias("body")), PRICE),
        sql(f"""SELECT symbol, {day()} AS day, {rq('(high + low + close) / 3', 9)} AS typical, {rq('high - low', 9)} AS range,
          {rq('abs(close - open)', 9)} AS body FROM bars"""),
    ),
    Case(
        "score_formulas", "H1, H2, H3, H4, H5",
        lambda t: rounded(t.sentiment_raw.select(
            "event_id", fm.rescale(F.col("score"), -0.5, 0.75).alias("unit"), fm.weighted(F.col("score"), 0.35).alias("weighted"),
            fm.mood_label(F.col("score") * 5).alias("label"), fm.tone(F.col("score")).alias("tone"),
            fm.mood_flags(F.col("score") * 5, F.col("confidence") * 4 - 3).alias("f")).select("*", "f.*").drop("f")),
        sql(f"""SELECT event_id, {rq('2 * (greatest(least(score, 0.75), -0.5) + 0.5) / 1.25 - 1')} AS unit, {rq('score * 0.35')} AS weighted,
          CASE WHEN score * 5 <= -3 THEN 'extreme_bearish' WHEN score * 5 <= -1.5 THEN 'bearish' WHEN score * 5 >= 3 THEN 'extreme_bullish'
            WHEN score * 5 >= 1.5 THEN 'bullish' ELSE 'neutral' END AS label,
          CASE WHEN score > 0.3 THEN 'bullish' WHEN score < -0.3 THEN 'bearish' ELSE 'neutral' END AS tone,
          confidence * 4 - 3 < -1 AS rapid_deterioration, confidence * 4 - 3 > 1 AS rapid_improvement,
          score * 5 <= -3 AS extreme_bearish, score * 5 >= 3 AS extreme_bullish, score * 5 > -3 AND score * 5 <= -1.5 AS bearish,
          score * 5 >= 1.5 AND score * 5 < 3 AS bullish, score * 5 > -1.5 AND score * 5 < 1.5 AS neutral FROM sentiment_raw"""),
    ),
    Case(
        "id_texts", "H41",
        lambda t: t.sentiment_raw.select(
            "event_id", id_text(F.col("symbol"), F.col("ts")).alias("trade_id"),
            id_text(F.col("symbol"), F.col("ts"), "_EXIT").alias("exit_id"),
            order_id_text(F.col("symbol"), F.col("ts")).alias("order_id")),
        sql("""SELECT event_id, symbol || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS trade_id,
          symbol || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_EXIT' AS exit_id,
          'ORD_' || symbol || '_' || strftime(ts, '%Y%m%d%H%M%S') AS order_id FROM sentiment_raw"""),
    ),
    Case(
        "bars_resampled_monthly", "S7", lambda t: rounded(market.resample(t.bars, "month", "day"), PRICE),
        sql(f"""SELECT symbol, {stamp('bucket')} AS bucket, {rq('arg_min(open, day)', 9)} AS open, {rq('max(high)', 9)} AS high,
          {rq('min(low)', 9)} AS low, {rq('arg_max(close, day)', 9)} AS close, {rq('sum(volume)')} AS volume, count(*) AS n_bars
          FROM (SELECT *, CAST(date_trunc('month', day) AS TIMESTAMP) AS bucket FROM bars) GROUP BY symbol, bucket"""),
    ),
    Case(
        "bars_resampled_weekly", "S7", lambda t: rounded(market.resample(t.bars, "week", "day"), PRICE),
        sql(f"""SELECT symbol, {stamp('bucket')} AS bucket, {rq('arg_min(open, day)', 9)} AS open, {rq('max(high)', 9)} AS high,
          {rq('min(low)', 9)} AS low, {rq('arg_max(close, day)', 9)} AS close, {rq('sum(volume)')} AS volume, count(*) AS n_bars
          FROM (SELECT *, CAST(date_trunc('week', day) AS TIMESTAMP) AS bucket FROM bars) GROUP BY symbol, bucket"""),
    ),
]


def _snapshot(t):
    path = f"{shared_folder(t.spark)}/positions-{uuid.uuid4().hex}"
    store.write_snapshot(t.held.limit(0), path, 1)
    store.write_snapshot(t.held, path, 2)
    return rounded(store.read_snapshot(t.spark, path), PRICE)
