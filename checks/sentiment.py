"""Blending, the sentiment series, and the scoring of vendor tables and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentifold.operators.blend import total_score
from sentifold.operators.latest import earliest, newest_rows
from sentifold.operators.series import with_change, with_ema, with_prior_zscore, with_rolling_stats
from sentifold.plans import mood as pm
from sentifold.plans import scoring, strategies

from .case import Case, day, rounded, rq, stamp
from .market import TS, D
from .views import sql

AS_OF = "2024-02-01"


def _totals(t):
    return total_score(
        t.sentiment_raw.withColumn("day", F.to_date("ts")), ["symbol", "day"], ["ts", "event_id"]
    )


def _series(t, *steps):
    df = _totals(t).select("symbol", "day", "total")
    for step in steps:
        df = step(df)
    return df


_ema = lambda df: with_ema(df, ["symbol"], ["day"], "total", 0.2)


def _meta(df, *names):
    return rounded(df.select(
        "symbol", "score", "confidence", *(F.col("metadata")[n].cast("double").alias(n) for n in names)))


def _article_feed(t):
    """JSON articles: fields missing here and there, scores in and out of [0, 1]."""
    i = F.col("event_id")
    cents = ((i % 301 - 150) / 100.0).cast("decimal(6,2)").cast("string")
    field = lambda keep, text: F.when(keep, text).otherwise(F.lit(""))
    body = F.concat(
        F.lit('{"id":"'), i.cast("string"), F.lit('"'),
        field(i % 9 != 0, F.concat(F.lit(',"sentiment":'), cents)),
        field(i % 4 != 0, F.concat(F.lit(',"confidence":0.'), (10 + i % 80).cast("string"))),
        field(i % 5 != 0, F.concat(
            F.lit(',"published_at":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"'),
            F.lit(',"created_at":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"'))),
        field(i % 3 == 0, F.lit(',"platform":"board"')),
        F.lit("}"),
    )
    return t.sentiment_raw.select("symbol", body.alias("payload"))


def _volume_feed(t):
    i = F.col("event_id")
    change = ((i % 13 - 6) / 100.0).cast("decimal(6,2)").cast("string")
    body = F.concat(
        F.lit('{"volume":'), (i % 1000).cast("string"),
        F.when(i % 4 != 0, F.concat(F.lit(',"price_change":'), change)).otherwise(F.lit("")),
        F.lit(',"date":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"}'),
    )
    return t.sentiment_raw.select("symbol", body.alias("payload"))


RAW = "CASE WHEN event_id % 9 <> 0 THEN CAST(event_id % 301 - 150 AS DOUBLE) / 100 ELSE 0 END"
WHEN_TS = f"CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '{AS_OF} 00:00:00' END || '.000000'"
CONF = "CASE WHEN event_id % 4 <> 0 THEN CAST(10 + event_id % 80 AS DOUBLE) / 100 ELSE {} END"


def _feed_shape(df, key):
    return rounded(df.select("symbol", "normalized", "confidence", "raw_sentiment", "ts", F.col("metadata")[key].alias(key)))


CASES = [
    Case(
        "composite_daily", "D1, E20, K2",
        lambda t: rounded(t.composite.select(
            "symbol", "day", "score", "confidence", "n_sources",
            *(F.col("source_scores")[s].alias(s) for s in ("news", "social", "search", "forum")))),
        sql(f"""SELECT symbol, {day()} AS day, {rq('score')} AS score, {rq('confidence')} AS confidence, n_sources,
          {rq('news')} AS news, {rq('social')} AS social, {rq('search')} AS search, {rq('forum')} AS forum FROM composite"""),
    ),
    Case(
        "first_row_per_source", "E20",
        lambda t: rounded(earliest(
            t.sentiment_raw.filter("source <> 'other'").select("symbol", "source", "ts", "event_id", "score"),
            ["symbol", "source"], ["ts", "event_id"])),
        sql(f"""SELECT symbol, source, {stamp()} AS ts, event_id, {rq('score')} AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol, source ORDER BY ts, event_id) AS rn
          FROM sentiment_raw WHERE source <> 'other') WHERE rn = 1"""),
    ),
    Case(
        "total_score_daily", "D2",
        lambda t: rounded(_totals(t).select("symbol", "day", "total", "mean_confidence")),
        sql(f"""SELECT symbol, {day()} AS day, {rq('total')} AS total, {rq('mean_confidence')} AS mean_confidence FROM totals"""),
    ),
    Case(
        "source_contributions", "D3",
        lambda t: rounded(_totals(t).select("symbol", "day", F.explode("source_scores").alias("source", "contribution")).join(
            _totals(t).select("symbol", "day", F.explode("confidences").alias("source", "confidence")), ["symbol", "day", "source"])),
        sql(f"""SELECT symbol, {day()} AS day, source, {rq('score * w * 5')} AS contribution, {rq('confidence')} AS confidence FROM last_of_source"""),
    ),
    Case(
        "sentiment_ema", "E1", lambda t: rounded(_series(t, _ema)),
        sql(f"SELECT symbol, {day()} AS day, {rq('total')} AS total, {rq('ema')} AS ema FROM mood0"),
    ),
    Case(
        "close_ema", "E1",
        lambda t: rounded(with_ema(t.bars.select("symbol", "day", "close"), ["symbol"], ["day"], "close", 0.2).select("symbol", "day", "ema"), 4),
        sql(f"SELECT symbol, {day()} AS day, {rq('ema', 4)} AS ema FROM walk",
            ordered="SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM bars",
            walk="""SELECT symbol, n, day, close AS ema FROM ordered WHERE n = 1
              UNION ALL SELECT o.symbol, o.n, o.day, 0.2 * o.close + 0.8 * w.ema FROM walk w JOIN ordered o
              ON o.symbol = w.symbol AND o.n = w.n + 1"""),
    ),
    Case(
        "sentiment_roc", "E2",
        lambda t: rounded(_series(t, _ema, lambda d: with_change(d, ["symbol"], ["day"], "ema")).select("symbol", "day", "roc")),
        sql(f"SELECT symbol, {day()} AS day, {rq('roc')} AS roc FROM mood0"),
    ),
    Case(
        "sentiment_rolling_stats", "E3",
        lambda t: rounded(_series(t, _ema, lambda d: with_rolling_stats(d, ["symbol"], ["day"], "ema")).drop("total")),
        sql(f"""SELECT symbol, {day()} AS day, {rq('ema')} AS ema, {rq('mean')} AS mean, {rq('std')} AS std,
          {rq('min')} AS min, {rq('max')} AS max FROM mood0"""),
    ),
    Case(
        "sentiment_zscore", "E4",
        lambda t: rounded(_series(t, _ema, lambda d: with_prior_zscore(d, ["symbol"], ["day"], "ema")).select("symbol", "day", "z_score"), 5),
        sql(f"SELECT symbol, {day()} AS day, {rq('z_score', 5)} AS z_score FROM mood0"),
    ),
    Case(
        "sentiment_extremes", "E5",
        lambda t: rounded(t.mood.select("symbol", "day", "rows_seen", "extreme_value", "is_extreme"), 5),
        sql(f"""SELECT symbol, {day()} AS day, n AS rows_seen, {rq('extreme_value', 5)} AS extreme_value, is_extreme FROM mood"""),
    ),
    Case(
        "newest_rows", "E6",
        lambda t: rounded(newest_rows(t.sentiment_raw.select("symbol", "ts", "event_id"), ["symbol"], ["ts", "event_id"], 20)),
        sql(f"""SELECT symbol, {stamp()} AS ts, event_id FROM (SELECT symbol, ts, event_id,
          row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS rn FROM sentiment_raw) WHERE rn <= 20"""),
    ),
    Case(
        "sentiment_series", "K3, H3, H4",
        lambda t: rounded(t.mood.select("symbol", "day", "total", "ema", "roc", "label", "is_extreme", "flags.*"), 5),
        sql(f"""SELECT symbol, {day()} AS day, {rq('total', 5)} AS total, {rq('ema', 5)} AS ema, {rq('roc', 5)} AS roc, label, is_extreme,
          roc < -1 AS rapid_deterioration, roc > 1 AS rapid_improvement, ema <= -3 AS extreme_bearish, ema >= 3 AS extreme_bullish,
          ema > -3 AND ema <= -1.5 AS bearish, ema >= 1.5 AND ema < 3 AS bullish, ema > -1.5 AND ema < 1.5 AS neutral FROM mood"""),
    ),
    Case(
        "sentiment_series_between", "B8",
        lambda t: rounded(pm.series_between(t.mood.select("symbol", "day", "ema"), D("2024-01-10"), D("2024-01-20"))),
        sql(f"""SELECT symbol, {day()} AS day, {rq('ema')} AS ema FROM mood0
          WHERE mood0.day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'"""),
    ),
    Case(
        "mean_sentiment_lookback", "D4",
        lambda t: rounded(strategies.mean_mood(t.sentiment_raw, TS("2024-01-25"), 5)),
        sql(f"""SELECT symbol, {rq('avg(score)')} AS mean_score FROM sentiment_raw
          WHERE ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-25' GROUP BY symbol"""),
    ),
    # --- vendor scoring -----------------------------------------------------
    Case(
        "popularity", "E15",
        lambda t: rounded(scoring.popularity(t.vendor()["hot_rank"]), 9),
        sql(f"SELECT raw_symbol, CAST(substr(raw_symbol, 3) AS BIGINT) AS rank, {rq('pct', 9)} AS popularity FROM social"),
    ),
    Case(
        "score_social", "H6, C1, H11",
        lambda t: _meta(scoring.score_social(t.vendor()["hot_rank"], t.vendor()["spot"], AS_OF), "rank_percentile", "price_change_pct"),
        sql(f"""SELECT symbol, {rq('score')} AS score, {rq('confidence')} AS confidence, {rq('pct')} AS rank_percentile,
          {rq('chg')} AS price_change_pct FROM social"""),
    ),
    Case(
        "score_news", "H7, C2, H12, G3",
        lambda t: _meta(scoring.score_news(t.vendor()["dragon_tiger"], t.vendor()["northbound"], AS_OF), "dt_net_ratio", "northbound_change"),
        sql(f"""SELECT symbol, {rq('score')} AS score, {rq('confidence')} AS confidence, {rq('ratio')} AS dt_net_ratio,
          {rq('change')} AS northbound_change FROM news"""),
    ),
    Case(
        "score_forum", "H8, H10, C3",
        lambda t: _meta(scoring.score_forum(
            t.vendor()["fund_flow"], scoring.margin_table(t.vendor()["margin_a"], t.vendor()["margin_b"]), AS_OF),
            "main_force_ratio", "margin_change"),
        sql(f"""SELECT symbol, {rq('score')} AS score, 0.6::DOUBLE AS confidence, {rq('ratio')} AS main_force_ratio,
          {rq('drift')} AS margin_change FROM forum"""),
    ),
    Case(
        "score_search", "H9, H10, C4",
        lambda t: _meta(scoring.score_search(
            scoring.margin_table(t.vendor()["margin_a"], t.vendor()["margin_b"]), t.vendor()["spot"], AS_OF),
            "margin_change", "volume_ratio"),
        sql(f"""SELECT symbol, {rq('score')} AS score, 0.5::DOUBLE AS confidence, {rq('drift')} AS margin_change,
          {rq('ratio')} AS volume_ratio FROM search"""),
    ),
    Case(
        "score_all_sources", "K1, G1",
        lambda t: rounded(scoring.score_sources(t.vendor(), AS_OF).select("symbol", "ts", "source", "score", "confidence")),
        sql(f"""SELECT symbol, '{AS_OF} 00:00:00.000000' AS ts, source, {rq('score')} AS score, {rq('confidence')} AS confidence FROM (
          SELECT symbol, 'social' AS source, score, confidence FROM social UNION ALL
          SELECT symbol, 'news', score, confidence FROM news UNION ALL
          SELECT symbol, 'forum', score, 0.6 FROM forum UNION ALL SELECT symbol, 'search', score, 0.5 FROM search)"""),
    ),
    Case(
        "composite_of_scores", "K1, K2",
        lambda t: rounded(pm.daily_composite(scoring.score_sources(t.vendor(), AS_OF), ["ts"]).select("symbol", "score", "confidence", "n_sources")),
        sql(f"""SELECT symbol, {rq('sum(score * w) / sum(w)')} AS score, {rq('avg(confidence)')} AS confidence, count(*) AS n_sources FROM (
          SELECT symbol, 'social' AS source, score, confidence FROM social UNION ALL
          SELECT symbol, 'news', score, confidence FROM news UNION ALL
          SELECT symbol, 'forum', score, 0.6 FROM forum UNION ALL SELECT symbol, 'search', score, 0.5 FROM search)
          JOIN weights USING (source) GROUP BY symbol"""),
    ),
    # --- feeds --------------------------------------------------------------
    Case(
        "article_feed", "H13, H43, H42", lambda t: _feed_shape(scoring.parse_articles(_article_feed(t), AS_OF), "article_id"),
        sql(f"""SELECT symbol, {rq('CASE WHEN raw >= 0 AND raw <= 1 THEN raw * 2 - 1 ELSE greatest(least(raw, 1), -1) END')} AS normalized,
          {rq(CONF.format('0.7'))} AS confidence, {rq('raw')} AS raw_sentiment, {WHEN_TS} AS ts, CAST(event_id AS VARCHAR) AS article_id
          FROM (SELECT *, {RAW} AS raw FROM sentiment_raw)"""),
    ),
    Case(
        "post_feed", "H14, H43", lambda t: _feed_shape(scoring.parse_posts(_article_feed(t), AS_OF), "platform"),
        sql(f"""SELECT symbol, {rq('greatest(least(raw, 1), -1)')} AS normalized,
          {rq(CONF.format('0.6'))} AS confidence, {rq('raw')} AS raw_sentiment, {WHEN_TS} AS ts,
          CASE WHEN event_id % 3 = 0 THEN 'board' ELSE 'unknown' END AS platform
          FROM (SELECT *, {RAW} AS raw FROM sentiment_raw)"""),
    ),
    Case(
        "search_volume_feed", "H15, D5",
        lambda t: rounded(scoring.parse_search_volume(_volume_feed(t), AS_OF).select(
            "symbol", "normalized", "confidence", "ts", F.col("metadata")["volume_ratio"].cast("double").alias("ratio"))),
        sql(f"""SELECT symbol, {rq('''CASE WHEN ratio > 1.5 THEN CASE WHEN chg < -0.02 THEN -0.7 WHEN chg > 0.02 THEN 0.7 ELSE 0.3 END
          ELSE 0 END::DOUBLE''')} AS normalized, 0.5::DOUBLE AS confidence, {day('CAST(ts AS DATE)')} || ' 00:00:00.000000' AS ts, {rq('ratio')} AS ratio FROM (
          SELECT symbol, ts, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 13 - 6 AS DOUBLE) / 100 ELSE 0 END AS chg,
            (event_id % 1000) / (avg(event_id % 1000) OVER () + 1e-8) AS ratio FROM sentiment_raw)"""),
    ),
]
