"""The store as files: written to the shared folder, read back, and held against SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from sentifold.operators.durable import shared_folder
from sentifold.plans import verdict as vp
from sentifold.plans.performance import cost_trades
from sentifold.sources import store
from sentifold.sources.schemas import SENTIMENT_COMPOSITE, conform

from .case import Case, rounded, rq, stamp
from .market import TS, D
from .trading import FIFO
from .views import sql


def _path(t) -> str:
    return f"{shared_folder(t.spark)}/stored-{uuid.uuid4().hex}"


def _observations(t):
    """Appended in two batches, then rid of what is too old."""
    path = _path(t)
    packed = store.pack_raw(t.sentiment_raw.withColumns(
        {"raw_score": F.col("score"), "sample_size": F.col("event_id"), "metadata": F.create_map(F.lit("k"), F.col("source"))}))
    for odd in (0, 1):
        store.append_raw(packed.filter(F.col("raw_data.sample_size") % 2 == odd), path)
    store.apply_retention(t.spark, path, dt.datetime(2024, 1, 31), 12)
    return store.unpack_raw(t.spark.read.parquet(path))


def _composites(t):
    """All days first, then the later days again with half the score."""
    path = _path(t)
    rows = t.composite.withColumn("ts", F.col("day").cast("timestamp_ntz"))
    first = conform(rows, SENTIMENT_COMPOSITE)
    later = conform(rows.filter(F.col("day") >= D("2024-01-12")).withColumn("score", F.col("score") / 2), SENTIMENT_COMPOSITE)
    store.upsert_composite(first, path)
    store.upsert_composite(later, path)
    return t.spark.read.parquet(path).select("symbol", "ts", "score", "confidence")


def _names(t):
    path = _path(t)
    store.upsert_names(t.names, path, 0, TS("2024-01-01"))
    renamed = t.names.filter(F.col("symbol").cast("bigint") % 4 == 0).select("symbol", F.concat(F.lit("new "), "symbol").alias("name"))
    store.upsert_names(renamed, path, 1, TS("2024-01-02"))
    return store.read_snapshot(t.spark, path)


def _trades(t):
    path = _path(t)
    store.write_csv(store.trade_report(cost_trades(t.fills).withColumn("source_signal", F.lit("ledger"))), path)
    schema = "trade_id string, symbol string, side string, quantity double, price double, timestamp string, commission double, source_signal string"
    return t.spark.read.schema(schema).csv(path, header=True, escape='"')


def _verdicts(t):
    path = _path(t)
    store.write_verdict_json(vp.verdicts(t.composite, t.fundamentals, t.names, n=10), path)
    return t.spark.read.schema("symbol string, name string, verdict string, sentiment_score double").json(path)


CASES = [
    Case(
        "stored_observations", "A6, A10, H42",
        lambda t: rounded(_observations(t).select("symbol", "ts", "source", "score", "sample_size", F.col("metadata")["k"].alias("k"))),
        sql(f"""SELECT symbol, {stamp()} AS ts, source, {rq('score')} AS score, event_id AS sample_size, source AS k
          FROM sentiment_raw WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 12 DAYS"""),
    ),
    Case(
        "stored_composites", "A7, K2", lambda t: rounded(_composites(t)),
        sql(f"""SELECT symbol, strftime(CAST(day AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS ts,
          {rq("CASE WHEN day >= DATE '2024-01-12' THEN score / 2 ELSE score END")} AS score, {rq('confidence')} AS confidence FROM composite"""),
    ),
    Case(
        "stored_names", "A8", lambda t: rounded(_names(t)),
        sql("""SELECT symbol, CASE WHEN CAST(symbol AS BIGINT) % 4 = 0 THEN 'new ' || symbol ELSE name END AS name,
          CASE WHEN CAST(symbol AS BIGINT) % 4 = 0 THEN '2024-01-02' ELSE '2024-01-01' END || ' 00:00:00.000000' AS updated_at FROM names"""),
    ),
    Case(
        "stored_trades", "A13", lambda t: rounded(_trades(t), 5),
        sql(f"""SELECT symbol || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS trade_id, symbol, side, quantity, {rq('price', 5)} AS price,
          strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, {rq('commission', 5)} AS commission, 'ledger' AS source_signal FROM costed""", **FIFO),
    ),
    Case(
        "stored_verdicts", "A14", lambda t: rounded(_verdicts(t), 5),
        sql(f"""SELECT symbol, coalesce(name, symbol) AS name, CASE WHEN s < 0 AND v > 0 THEN 'BUY' ELSE 'HOLD' END AS verdict, {rq('s', 5)} AS sentiment_score
          FROM picked JOIN market_value USING (symbol) LEFT JOIN names USING (symbol)""",
            picked="""SELECT symbol, score AS s FROM (SELECT symbol, score,
              row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM composite) WHERE rn = 1 ORDER BY score, symbol LIMIT 10"""),
    ),
]
