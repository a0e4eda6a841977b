"""Vendor tables over keys of more than six digits: each key keeps a code and rows of its own."""

from checks.tables import SCHEMAS, Tables
from sentifold.plans import scoring

KEYS = [2, 100_002, 1_000_020, 1_000_026]  # cut to six digits, the last two would share a code with the second


def stored(spark, folder):
    rows = {
        "part": [(k, "name", "Brand#1", "type", 10, 5.0) for k in KEYS],
        "customer": [(k, "name", 1, 100.0 + k % 7, "segment") for k in KEYS],
        "lineitem": [(k, k, 1, 1, 2.0, 10.0 + k % 9, 0.0, 0.1, "N", "O", None) for k in KEYS],
    }
    for name, r in rows.items():
        spark.createDataFrame(r, SCHEMAS[name]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, str(folder)).vendor()


def test_long_keys_keep_their_codes(spark, tmp_path):
    tables = stored(spark, tmp_path)
    codes = ["000002", "100002", "1000020", "1000026"]
    ranking = [(r.raw_symbol, r.rank) for r in scoring.popularity(tables["hot_rank"]).orderBy("rank").collect()]
    assert ranking == [("SH" + c, k) for c, k in zip(codes, KEYS) if k % 3 != 1]
    scored = scoring.score_sources(tables, "2024-02-01").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in scored} == {"social": len(ranking), "news": 4, "forum": 4, "search": 4}
    forum = scoring.score_sources(tables, "2024-02-01").filter("source = 'forum'")
    assert sorted(r.symbol for r in forum.collect()) == codes
