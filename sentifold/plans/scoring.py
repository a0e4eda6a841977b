"""Source scoring: seven vendor tables in, one table of sentiment observations out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mood
from ..functions.basic import first_existing, or_zero, parse_iso, strip_exchange, usable_symbol
from ..operators.segments import ordered, positions
from ..params import CODE_HEADERS
from ..sources.vendor import (
    dragon_tiger_table,
    fund_flow_table,
    margin_table,
    missing,
    northbound_table,
    spot_table,
)


def _observation(df: DataFrame, source: str, score: Column, confidence: Column, as_of, **meta: Column) -> DataFrame:
    entries = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        "symbol",
        F.lit(as_of).cast("timestamp_ntz").alias("ts"),
        F.lit(source).alias("source"),
        score.alias("score"),
        confidence.cast("double").alias("confidence"),
        score.alias("raw_score"),
        F.lit(None).cast("bigint").alias("sample_size"),
        F.create_map(*entries).alias("metadata"),
    )


def popularity(hot_rank: DataFrame, dense_rank: bool = False, limit: int | None = None) -> DataFrame:
    """raw_symbol, popularity = 1 - position/total in the ranking, unusable codes still counting.

    With a dense rank the position is rank - 1.  Otherwise positions are counted, by range segments
    where the ranking is longer than one task should hold.
    """
    code = first_existing(hot_rank, ("code", *CODE_HEADERS[:1]), missing()).cast("string")
    ranked = hot_rank.select(code.alias("raw_symbol"), F.col("rank").cast("long").alias("rank"))
    if dense_rank:
        placed = ranked.withColumn("pos", F.col("rank") - 1)
        total = hot_rank.agg(F.count(F.lit(1))).scalar()
    else:
        counted = positions(ordered(ranked, [], ["rank", "raw_symbol"], limit))
        placed, total = counted.rows(), F.lit(counted.total)
    return (
        placed.withColumn("popularity", 1 - F.col("pos") / total)
        .filter(usable_symbol(F.col("raw_symbol")))
        .select("raw_symbol", "rank", "popularity")
    )


def score_social(hot_rank: DataFrame, spot: DataFrame, as_of, dense_rank: bool = False) -> DataFrame:
    """Popularity read with the day's price change; codes meet on the part after the exchange mark."""
    ranked = popularity(hot_rank, dense_rank).withColumn("symbol", strip_exchange(F.col("raw_symbol")))
    joined = ranked.join(spot_table(spot).select("symbol", "change_pct"), "symbol", "left").withColumn(
        "change_pct", or_zero(F.col("change_pct"))
    )
    p, change = F.col("popularity"), F.col("change_pct")
    return _observation(
        joined,
        "social",
        mood.social_score(p, change),
        mood.social_confidence(p),
        as_of,
        raw_symbol=F.col("raw_symbol"),
        rank_percentile=p,
        price_change_pct=change,
    )


def score_news(dragon_tiger: DataFrame, northbound: DataFrame, as_of) -> DataFrame:
    listed = dragon_tiger_table(dragon_tiger).select(
        "symbol", mood.net_ratio(F.col("net_buy")).alias("ratio"), F.lit(True).alias("listed")
    )
    joined = listed.join(northbound_table(northbound), "symbol", "full").select(
        "symbol",
        or_zero(F.col("ratio")).alias("ratio"),
        or_zero(F.col("holding_change")).alias("change"),
        F.coalesce("listed", F.lit(False)).alias("listed"),
    )
    return _observation(
        joined,
        "news",
        mood.news_score(F.col("ratio"), F.col("change")),
        mood.news_confidence(F.col("listed")),
        as_of,
        dt_net_ratio=F.col("ratio"),
        northbound_change=F.col("change"),
    )


def score_forum(fund_flow: DataFrame, margin: DataFrame, as_of) -> DataFrame:
    """``margin`` is the shaped table of :func:`margin_table`."""
    flow = fund_flow_table(fund_flow).select(
        "symbol", mood.flow_ratio(F.col("main_net"), F.col("retail_net")).alias("ratio")
    )
    drift = margin.select("symbol", mood.margin_drift(F.col("balance")).alias("drift"))
    joined = flow.join(drift, "symbol", "full").select(
        "symbol", or_zero(F.col("ratio")).alias("ratio"), or_zero(F.col("drift")).alias("drift")
    )
    return _observation(
        joined,
        "forum",
        mood.forum_score(F.col("ratio"), F.col("drift")),
        F.lit(0.6),
        as_of,
        main_force_ratio=F.col("ratio"),
        margin_change=F.col("drift"),
    )


def score_search(margin: DataFrame, spot: DataFrame, as_of) -> DataFrame:
    drift = margin.select("symbol", mood.margin_drift(F.col("balance")).alias("drift"))
    volume = spot_table(spot).select("symbol", mood.volume_ratio(F.col("volume")).alias("ratio"))
    joined = drift.join(volume, "symbol", "full").select(
        "symbol",
        or_zero(F.col("drift")).alias("drift"),
        F.coalesce("ratio", F.lit(1.0)).alias("ratio"),
    )
    return _observation(
        joined,
        "search",
        mood.search_score(F.col("drift"), F.col("ratio")),
        F.lit(0.5),
        as_of,
        margin_change=F.col("drift"),
        volume_ratio=F.col("ratio"),
    )


def score_sources(tables: dict[str, DataFrame], as_of, dense_rank: bool = False) -> DataFrame:
    """All four scores.  Tables: hot_rank, spot, dragon_tiger, northbound, fund_flow, margin_a, margin_b."""
    margin = margin_table(tables["margin_a"], tables["margin_b"])
    parts = [
        score_social(tables["hot_rank"], tables["spot"], as_of, dense_rank),
        score_news(tables["dragon_tiger"], tables["northbound"], as_of),
        score_forum(tables["fund_flow"], margin, as_of),
        score_search(margin, tables["spot"], as_of),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- feeds that arrive as JSON ----------------------------------------------


def _feed(df: DataFrame, source: str, raw, score, confidence, ts, metadata) -> DataFrame:
    return df.select(
        "symbol",
        F.lit(source).alias("source"),
        ts.alias("ts"),
        raw.alias("raw_sentiment"),
        score.alias("normalized"),
        confidence.cast("double").alias("confidence"),
        metadata.cast("map<string,string>").alias("metadata"),
    )


def parse_articles(feed: DataFrame, as_of, assume_unit_interval: bool = True) -> DataFrame:
    """``feed``: symbol, payload.  Absent fields take their defaults."""
    shape = "id string, sentiment double, published_at string, confidence double"
    a = feed.select("symbol", F.from_json("payload", shape).alias("a")).select("symbol", "a.*")
    raw = or_zero(F.col("sentiment"))
    return _feed(
        a,
        "news",
        raw,
        mood.article_score(raw, assume_unit_interval),
        F.coalesce("confidence", F.lit(0.7)),
        parse_iso(F.col("published_at"), F.lit(as_of).cast("timestamp_ntz")),
        F.create_map(F.lit("article_id"), F.col("id")),
    )


def parse_posts(feed: DataFrame, as_of) -> DataFrame:
    shape = "id string, sentiment double, created_at string, confidence double, platform string"
    a = feed.select("symbol", F.from_json("payload", shape).alias("a")).select("symbol", "a.*")
    raw = or_zero(F.col("sentiment"))
    return _feed(
        a,
        "social",
        raw,
        mood.post_score(raw),
        F.coalesce("confidence", F.lit(0.6)),
        parse_iso(F.col("created_at"), F.lit(as_of).cast("timestamp_ntz")),
        F.create_map(
            F.lit("platform"), F.coalesce("platform", F.lit("unknown")), F.lit("post_id"), F.col("id")
        ),
    )


def parse_search_volume(feed: DataFrame, as_of) -> DataFrame:
    """Volume against the mean of the whole batch (one scalar), read with the price change."""
    shape = "volume double, price_change double, date string"
    a = feed.select("symbol", F.from_json("payload", shape).alias("a")).select("symbol", "a.*")
    baseline = a.agg(F.avg("volume")).scalar()
    ratio = F.col("volume") / (baseline + 1e-8)
    change = or_zero(F.col("price_change"))
    a = a.withColumns({"ratio": ratio, "change": change})
    score = mood.interest_score(F.col("ratio"), F.col("change"))
    return _feed(
        a,
        "search",
        score,
        score,
        F.lit(0.5),
        parse_iso(F.col("date"), F.lit(as_of).cast("timestamp_ntz")),
        F.create_map(
            F.lit("volume"), F.col("volume").cast("string"),
            F.lit("volume_ratio"), F.col("ratio").cast("string"),
            F.lit("price_change"), F.col("change").cast("string"),
        ),
    )
