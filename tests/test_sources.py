"""Vendor tables, the store and report files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sentifold.operators import durable
from sentifold.plans import scoring
from sentifold.plans.mood import collect_and_publish
from sentifold.sources import market, store, vendor
from sentifold.sources.schemas import SENTIMENT_COMPOSITE, SENTIMENT_RAW, NAMES, conform

NOW = "2024-02-01"


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def empty(spark, ddl):
    return spark.createDataFrame([], ddl)


# --- vendor scoring ---------------------------------------------------------


def test_social_known(spark):
    hot = spark.createDataFrame([("SH600519", 1), ("000001", 2), ("nan", 3)], "`代码` string, rank long")
    spot = spark.createDataFrame([("600519", 9.0, 1), ("600519", 2.5, 2), ("000001", -3.0, 3)], "`代码` string, `涨跌幅` double, seq long")
    got = {r.symbol: (r.score, r.confidence) for r in scoring.score_social(hot, spot, NOW).collect()}
    assert got["600519"] == (0.6, 0.8)
    assert got["000001"] == pytest.approx((2 / 3 * 0.2, 2 / 3))
    assert set(got) == {"600519", "000001"}


def test_social_two_rows(spark):
    hot = spark.createDataFrame([("600519", 1), ("000001", 2)], "`代码` string, rank long")
    spot = spark.createDataFrame([("600519", 2.5), ("000001", -3.0)], "`代码` string, `涨跌幅` double")
    got = {r.symbol: (r.score, r.confidence) for r in scoring.score_social(hot, spot, NOW).collect()}
    assert got == {"600519": (0.6, 0.8), "000001": (pytest.approx(0.1), 0.5)}


def test_empty_tables_give_no_scores(spark):
    hot = empty(spark, "`代码` string, rank long")
    spot = empty(spark, "`代码` string, `涨跌幅` double, `成交量` double")
    margin = vendor.margin_table(empty(spark, "`标的证券代码` string, `融资余额` string"), empty(spark, "`证券代码` string, `融资余额` string"))
    assert scoring.score_social(hot, spot, NOW).isEmpty()
    assert scoring.score_news(empty(spark, "`代码` string, `龙虎榜净买额` double"), empty(spark, "`代码` string"), NOW).isEmpty()
    assert scoring.score_forum(empty(spark, "`代码` string, `主力净流入` double"), margin, NOW).isEmpty()
    assert scoring.score_search(margin, spot, NOW).isEmpty()


def test_news_header_fallbacks_and_text(spark):
    listed = spark.createDataFrame([("600519", "1,000,000"), ("1", "--"), ("", "5")], "`股票代码` string, `龙虎榜净买额` string")
    north = spark.createDataFrame([("600519", "50%"), ("2", None)], "`代码` string, `5日增持估计-占流通股比` string")
    got = {r.symbol: (r.score, r.confidence) for r in scoring.score_news(listed, north, NOW).collect()}
    assert got == {"600519": (pytest.approx(0.6 + 0.4 * 0.5), 0.7), "1": (0.0, 0.7), "2": (0.0, 0.4)}


def test_news_without_the_value_column(spark):
    listed = spark.createDataFrame([("600519", 1e6)], "`代码` string, `净买入` double")
    assert scoring.score_news(listed, empty(spark, "`代码` string"), NOW).first().score == 0.0


def test_forum_and_search_known(spark):
    flow = spark.createDataFrame([("600519", 5e6, 2e6)], "`代码` string, `主力净流入` double, `散户净流入` double")
    none = vendor.margin_table(empty(spark, "`证券代码` string"))
    r = scoring.score_forum(flow, none, NOW).first()
    assert (r.score, r.confidence) == (pytest.approx(0.428571, abs=1e-6), 0.6)
    margin = vendor.margin_table(
        spark.createDataFrame([("600519", "15,000,000")], "`标的证券代码` string, `融资余额` string"),
        spark.createDataFrame([("000001", "x")], "`证券代码` string, `融资余额` string"),
    )
    spot = spark.createDataFrame([("600519", 2e7)], "`代码` string, `成交量` double")
    got = {r.symbol: r.score for r in scoring.score_search(margin, spot, NOW).collect()}
    assert got == {"600519": pytest.approx(0.7), "000001": pytest.approx(-0.6)}


def test_landed_formats(spark, tmp_path):
    df = spark.createDataFrame([("1", 2.5)], "code string, volume double")
    df.write.csv(f"{tmp_path}/c", header=True)
    df.write.json(f"{tmp_path}/j")
    df.write.parquet(f"{tmp_path}/p")
    read = lambda p, f, **o: rows(vendor.read_landed(spark, f"{tmp_path}/{p}", f, "code string, volume double", **o), "code", "volume")
    assert read("c", "csv", header="true") == read("j", "json") == read("p", "parquet") == {("1", 2.5)}
    with pytest.raises(ValueError):
        vendor.read_landed(spark, f"{tmp_path}/c", "csv")


def test_repeated_codes_give_a_whole_row(spark, tmp_path):
    rows_ = [("1", -3.0, 9e6), ("1", 2.5, 1e6), ("2", 1.0, 5.0)]
    df = spark.createDataFrame(rows_, "code string, change_pct double, volume double")
    got = {r.symbol: (r.change_pct, r.volume) for r in vendor.spot_table(df).collect()}
    assert got == {"1": (2.5, 1e6), "2": (1.0, 5.0)}
    for n, r in enumerate([rows_[1], rows_[2], rows_[0]]):  # landed later, so it counts
        spark.createDataFrame([r], df.schema).coalesce(1).write.parquet(f"{tmp_path}/feed/batch={n}")
    fed = vendor.read_landed(spark, f"{tmp_path}/feed")
    got = {r.symbol: (r.change_pct, r.volume) for r in vendor.spot_table(fed).collect()}
    assert got == {"1": (-3.0, 9e6), "2": (1.0, 5.0)}


# --- store ------------------------------------------------------------------


def raw(spark):
    data = [
        ("600519", dt.datetime(2024, 1, 1), "news", 0.5, 0.8),
        ("000001", dt.datetime(2024, 1, 2), "social", -0.3, 0.6),
        ("600519", dt.datetime(2024, 1, 3), "social", 0.3, 0.6),
    ]
    df = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, source string, score double, confidence double")
    return df.withColumns({"raw_score": F.col("score"), "sample_size": F.lit(3), "metadata": F.create_map(F.lit("k"), F.lit("v"))})


def test_raw_append_and_history(spark, tmp_path):
    path = f"{tmp_path}/raw"
    store.append_raw(store.pack_raw(raw(spark)), path)
    store.append_raw(store.pack_raw(raw(spark).limit(1)), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 4
    got = store.unpack_raw(store.history(stored, ["600519", "000001"], dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3))).collect()
    assert [(r.symbol, r.source) for r in got] == [("600519", "social"), ("000001", "social")]
    assert got[0].metadata == {"k": "v"} and got[0].sample_size == 3
    only = store.history(stored, ["600519"], dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9), "news")
    assert only.count() == 2
    assert rows(store.latest_raw(stored), "symbol", "source") == {("600519", "social"), ("000001", "social")}


def test_json_round_trip_and_missing_metadata(spark):
    packed = store.pack_raw(raw(spark).withColumn("metadata", F.lit(None).cast("map<string,string>")))
    back = store.unpack_raw(store.raw_from_json(store.raw_to_json(packed)))
    assert [r.metadata for r in back.collect()] == [{}] * 3


def test_composite_upsert(spark, tmp_path):
    path = f"{tmp_path}/composite"

    def batch(*items):
        return conform(spark.createDataFrame(list(items), "symbol string, ts timestamp_ntz, score double"), SENTIMENT_COMPOSITE)

    day = lambda d: dt.datetime(2024, 1, d)
    store.upsert_composite(batch(("a", day(1), 0.4), ("b", day(1), 0.1), ("a", day(2), 0.2)), path)
    before = {f for d, _, fs in os.walk(f"{path}/dt=2024-01-02") for f in fs if f.endswith(".parquet")}
    store.upsert_composite(batch(("a", day(1), 0.9), ("c", day(3), 0.3)), path)
    got = rows(spark.read.parquet(path), "symbol", "ts", "score")
    assert got == {("a", day(1), 0.9), ("b", day(1), 0.1), ("a", day(2), 0.2), ("c", day(3), 0.3)}
    after = {f for d, _, fs in os.walk(f"{path}/dt=2024-01-02") for f in fs if f.endswith(".parquet")}
    assert before == after  # an untouched day is not rewritten
    touched = store.touched_days(spark.read.parquet(path), batch(("a", day(2), 0.5)).withColumn("dt", F.to_date("ts")))
    plan = touched._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters:") :].split("]")[0]
    assert "dt#" in filters and "IN" in filters.upper() or "= 2024" in filters or "19724" in filters, filters
    with pytest.raises(ValueError):
        store.upsert_composite(batch(("a", day(9), 0.1), ("a", day(9), 0.2)), path)


def test_collect_and_publish(spark, tmp_path):
    scores = raw(spark).withColumn("ts", F.lit("2024-01-05").cast("timestamp_ntz"))
    collect_and_publish(scores, f"{tmp_path}/raw", f"{tmp_path}/composite")
    collect_and_publish(scores, f"{tmp_path}/raw", f"{tmp_path}/composite")
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 6
    got = {r.symbol: r.score for r in spark.read.parquet(f"{tmp_path}/composite").collect()}
    assert got == {"600519": pytest.approx((0.5 * 0.4 + 0.3 * 0.35) / 0.75), "000001": pytest.approx(-0.3)}


def test_retention(spark, tmp_path):
    path = f"{tmp_path}/raw"
    times = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5, 11), dt.datetime(2024, 1, 5, 13), dt.datetime(2024, 1, 9)]
    df = conform(spark.createDataFrame([("a", t) for t in times], "symbol string, ts timestamp_ntz"), SENTIMENT_RAW)
    store.append_raw(df, path)
    assert store.apply_retention(spark, path, dt.datetime(2024, 1, 10, 12), 5) == 2
    assert {r.ts for r in spark.read.parquet(path).collect()} == set(times[2:])
    assert store.apply_retention(spark, path, dt.datetime(2024, 1, 10, 12), 5) == 0
    exact = store.keep_recent(df, F.lit("2024-01-10 13:00:00").cast("timestamp_ntz"), 5)
    assert {r.ts for r in exact.collect()} == set(times[2:])


def test_names_and_snapshots(spark, tmp_path):
    path = f"{tmp_path}/names"
    names = lambda *items: spark.createDataFrame(list(items), "symbol string, name string")
    store.upsert_names(names(("1", "one"), ("2", "two")), path, 1, "2024-01-01")
    store.upsert_names(names(("2", "deux"), ("3", "trois")), path, 2, "2024-01-02")
    store.upsert_names(names(("2", "deux"), ("3", "trois")), path, 2, "2024-01-02")
    kept = store.read_snapshot(spark, path)
    assert rows(kept, "symbol", "name") == {("1", "one"), ("2", "deux"), ("3", "trois")}
    assert kept.columns == [c.split()[0] for c in NAMES.split(", ")]
    wanted = names(("1", ""), ("9", ""))
    assert rows(store.names_of(kept, wanted), "name") == {("one",)}
    assert rows(store.without_name(wanted, kept), "symbol") == {("9",)}


def test_confidence_split(spark):
    df = spark.createDataFrame([(c,) for c in (0.0, 0.5, 1.0, -0.1, 1.5, None)], "confidence double")
    good, bad = store.split_by_confidence(df)
    assert good.count() == 3 and bad.count() == 3


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], {"k": 1.0})], "symbol string, reasons array<string>, parts map<string,double>")
    store.write_csv(df, f"{tmp_path}/signals")
    (r,) = spark.read.csv(f"{tmp_path}/signals", header=True, escape='"').collect()
    assert r.reasons == '["x","y"]'
    verdict = spark.createDataFrame(
        [("a", "n", -0.123456, 0.2, 51.755, "BUY", None, 1.5, 0.02, None, 0.9)],
        "symbol string, name string, sentiment_score double, valuation_score double, combined_score double, verdict string, "
        "pe_ratio double, pb_ratio double, dividend_yield double, peg_ratio double, confidence double",
    )
    store.write_csv(store.verdict_csv(verdict), f"{tmp_path}/v")
    (v,) = spark.read.csv(f"{tmp_path}/v", header=True).collect()
    assert (v.sentiment_score, v.valuation_score, v.confidence, v.pe_ratio) == ("-0.1235", "0.2000", "0.90", None)
    assert len(v) == 10
    store.write_verdict_json(verdict, f"{tmp_path}/j")
    (j,) = spark.read.json(f"{tmp_path}/j").collect()
    assert len(j) == 11 and j.pe_ratio is None


# --- market reads -----------------------------------------------------------


def test_bars_range_is_inclusive_and_pushed_down(spark, tmp_path):
    df = spark.createDataFrame([(s, dt.date(2024, 1, d), float(d)) for s in "ab" for d in range(1, 6)], "symbol string, day date, close double")
    df.write.parquet(f"{tmp_path}/bars")
    bars = spark.read.parquet(f"{tmp_path}/bars")
    got = market.bars_between(bars, ["a"], dt.date(2024, 1, 2), dt.date(2024, 1, 4), "day").select("symbol", "day")
    assert got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day" in plan and "EqualTo(symbol,a)" in plan
    assert "close" not in plan.split("ReadSchema")[1]


def test_universe_table_is_a_semi_join(spark):
    bars = spark.createDataFrame([("a", 1), ("b", 2)], "symbol string, x int")
    members = spark.createDataFrame([("core", "a"), ("core", "a"), ("rest", "b")], "universe string, symbol string")
    assert rows(market.in_universe(bars, market.universe(members, "core")), "symbol", "x") == {("a", 1)}


def test_resample_minutes(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 9, m)
    data = [("a", t(m), float(m), m + 1.0, m - 1.0, m + 0.5, 10.0) for m in (0, 3, 4, 5, 9)]
    df = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    got = {r.bucket.minute: (r.open, r.high, r.low, r.close, r.volume, r.n_bars) for r in market.resample(df, "5 minutes").collect()}
    assert got == {0: (0.0, 5.0, -1.0, 4.5, 30.0, 3), 5: (5.0, 10.0, 4.0, 9.5, 20.0, 2)}


def test_checkpoint_folder_is_the_sessions(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    assert durable.shared_folder(spark) == (folder or spark.conf.get("spark.checkpoint.dir"))
