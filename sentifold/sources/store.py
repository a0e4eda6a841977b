"""The sentiment store on partitioned Parquet: history reads, upserts, retention, snapshots.

Tables are partitioned by ``dt`` (the day).  An upsert rewrites only the days it touches.  Nothing
is read and overwritten in one plan: the merged rows are first made durable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basic import usable_symbol
from ..operators.durable import durable
from ..operators.latest import latest
from .market import in_universe
from .schemas import SENTIMENT_RAW, conform


# --- raw observations -------------------------------------------------------


def split_by_confidence(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a confidence in [0, 1], and the rejects."""
    good = F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
    return raw.filter(good), raw.filter(~good)


def pack_raw(scores: DataFrame) -> DataFrame:
    """Fold raw_score, sample_size and metadata into one struct column."""
    packed = F.struct(
        F.col("raw_score").cast("double").alias("raw_score"),
        F.col("sample_size").cast("bigint").alias("sample_size"),
        F.col("metadata").cast("map<string,string>").alias("metadata"),
    )
    return conform(scores.withColumn("raw_data", packed), SENTIMENT_RAW)


def unpack_raw(raw: DataFrame) -> DataFrame:
    """The reverse; a missing metadata map reads as an empty one."""
    empty = F.create_map().cast("map<string,string>")
    return raw.select(
        *(c for c in raw.columns if c != "raw_data"),
        "raw_data.raw_score",
        "raw_data.sample_size",
        F.coalesce(F.col("raw_data.metadata"), empty).alias("metadata"),
    )


def raw_to_json(raw: DataFrame) -> DataFrame:
    return raw.withColumn("raw_data", F.to_json("raw_data", {"ignoreNullFields": "false"}))


def raw_from_json(raw: DataFrame) -> DataFrame:
    shape = "raw_score double, sample_size bigint, metadata map<string,string>"
    return raw.withColumn("raw_data", F.from_json("raw_data", shape))


def append_raw(scores: DataFrame, path: str) -> None:
    scores.withColumn("dt", F.to_date("ts")).write.mode("append").partitionBy("dt").parquet(path)


def history(
    raw: DataFrame, symbols: Sequence[str] | DataFrame, start, end, source: str | None = None
) -> DataFrame:
    """Observations of a symbol set between two times (inclusive), newest first."""
    rows = in_universe(raw, symbols).filter(F.col("ts").between(start, end))
    if "dt" in raw.columns:  # prune partitions as well as rows
        rows = rows.filter(F.col("dt").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    return rows.orderBy(F.desc("ts"), "symbol", "source")


def latest_raw(raw: DataFrame) -> DataFrame:
    """Newest observation per symbol; equal times fall back on source, then score."""
    return latest(raw, ["symbol"], ["ts", "source", "score"])


def latest_composite(composite: DataFrame, ts: str = "ts") -> DataFrame:
    return latest(composite, ["symbol"], [ts])


def source_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("symbol").alias("n_symbols")
    )


def known_sources(raw: DataFrame, sources: Sequence[str]) -> DataFrame:
    return raw.filter(F.col("source").isin(*sources) & usable_symbol(F.col("symbol")))


def expired(ts: Column, as_of: Column, days: int) -> Column:
    """True strictly before ``as_of`` minus the retention."""
    return ts < as_of - F.make_dt_interval(days=F.lit(days))


def keep_recent(raw: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    return raw.filter(~expired(F.col("ts"), as_of, days))


def retention_report(raw: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    old = expired(F.col("ts"), as_of, days)
    return raw.agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"))


def apply_retention(spark: SparkSession, path: str, as_of, days: int = 365) -> int:
    """Drop old rows of a stored table and return their number.

    Whole days before the limit are removed as folders; only the day of the limit is rewritten.
    """
    limit = F.lit(as_of).cast("timestamp_ntz")
    stored = spark.read.parquet(path)
    old = expired(F.col("ts"), limit, days)
    # Only days up to the limit are scanned; one row per day on the driver: bounded by the calendar.
    before = F.col("dt") <= F.to_date(limit)
    affected = stored.filter(before & old).groupBy("dt").agg(F.count(F.lit(1)).alias("n")).collect()
    if not affected:
        return 0
    edge = max(r["dt"] for r in affected)
    rest = durable(stored.filter((F.col("dt") == F.lit(edge)) & ~old))
    survivors = not rest.isEmpty()
    if survivors:
        _replace_days(rest, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in affected:
        if r["dt"] != edge or not survivors:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"dt={r['dt']}"), True)
    return sum(r["n"] for r in affected)


# --- upserts ----------------------------------------------------------------


def merge_newest(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union in which a key of ``new`` replaces the same key of ``old``.

    ``new`` must have one row per key.
    """
    rows = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return latest(rows, keys, ["_gen"]).drop("_gen").select(*old.columns)


def _replace_days(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt")
        .parquet(path)
    )


def upsert_composite(new: DataFrame, path: str, keys: Sequence[str] = ("symbol", "ts")) -> None:
    """Insert or replace rows by key, reading and rewriting only the days present in ``new``.

    ``new`` must have one row per key.
    """
    spark = new.sparkSession
    new = durable(new.withColumn("dt", F.to_date("ts")))
    if not new.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated keys {list(keys)} in an upsert")
    old = _read_or_none(spark, path)
    if old is None:
        _replace_days(new, path)
        return
    _replace_days(durable(merge_newest(touched_days(old, new), new, keys)), path)


def touched_days(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the stored table on the days of ``new``: a partition filter, as the days are a bounded list."""
    days = [r["dt"] for r in new.select("dt").distinct().collect()]
    return old.filter(F.col("dt").isin(days))


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path)


# --- snapshots: name dimension and positions --------------------------------


def write_snapshot(df: DataFrame, path: str, number: int, keep: int | None = None) -> None:
    """Write one numbered snapshot beside the earlier ones; repeating a number replaces it.

    A marker row makes an empty snapshot exist, so that a reader does not fall back to an older one.
    With ``keep`` only so many snapshots remain: readers of older ones must be done.
    """
    marker = df.sparkSession.range(1).select(
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema), F.lit(False).alias("present")
    )
    (
        df.withColumn("present", F.lit(True))
        .unionByName(marker)
        .withColumn("snapshot", F.lit(number).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot")
        .parquet(path)
    )
    if keep is not None:
        jvm = df.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
        for status in fs.listStatus(folder):
            name, _, n = status.getPath().getName().partition("=")
            if name == "snapshot" and int(n) <= number - keep:
                fs.delete(status.getPath(), True)


def read_snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The highest snapshot (below ``before``); the number is a partition value, so only that one is
    scanned."""
    stored = spark.read.parquet(path)
    if before is not None:
        stored = stored.filter(F.col("snapshot") < before)
    newest = stored.agg(F.max("snapshot")).scalar()
    return stored.filter((F.col("snapshot") == newest) & F.col("present")).drop("snapshot", "present")


def upsert_names(new: DataFrame, path: str, number: int, as_of) -> None:
    """Add or rename symbols of the name dimension."""
    spark = new.sparkSession
    fresh = new.select("symbol", "name", F.lit(as_of).cast("timestamp_ntz").alias("updated_at"))
    if _read_or_none(spark, path) is not None:
        fresh = durable(merge_newest(read_snapshot(spark, path), fresh, ["symbol"]))
    write_snapshot(fresh, path, number)


def all_names(names: DataFrame) -> DataFrame:
    return names.select("symbol", "name")


def names_of(names: DataFrame, symbols: DataFrame) -> DataFrame:
    return names.join(symbols.select("symbol"), "symbol", "left_semi").select("symbol", "name")


def without_name(symbols: DataFrame, names: DataFrame) -> DataFrame:
    return symbols.select("symbol").distinct().join(names.select("symbol"), "symbol", "left_anti")


# --- report files -----------------------------------------------------------


def _text_columns(df: DataFrame) -> list[Column]:
    """Nested columns as JSON text, the rest as they are: CSV holds flat values only."""
    nested = ("array", "map", "struct")
    return [
        F.to_json(n).alias(n) if t.startswith(nested) else F.col(n) for n, t in df.dtypes
    ]


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*_text_columns(df)).write.mode("overwrite").csv(path, header=True, escape='"')


def trade_report(trades: DataFrame) -> DataFrame:
    """The eight published trade columns."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")
    return trades.select("trade_id", "symbol", "side", "quantity", "price", stamp, "commission", "source_signal")


def equity_report(curve: DataFrame) -> DataFrame:
    return curve.select("date", "equity", "cash", "positions_value")


def verdict_csv(verdicts: DataFrame) -> DataFrame:
    """The ten verdict columns with their fixed number of decimals."""
    return verdicts.select(
        "symbol",
        "name",
        F.format_string("%.4f", "sentiment_score").alias("sentiment_score"),
        F.format_string("%.4f", "valuation_score").alias("valuation_score"),
        F.format_string("%.2f", "combined_score").alias("combined_score"),
        "verdict",
        "pe_ratio",
        "pb_ratio",
        "dividend_yield",
        F.format_string("%.2f", "confidence").alias("confidence"),
    )


def write_verdict_json(verdicts: DataFrame, path: str) -> None:
    columns = (
        "symbol", "name", "sentiment_score", "valuation_score", "combined_score", "verdict",
        "pe_ratio", "pb_ratio", "dividend_yield", "peg_ratio", "confidence",
    )
    verdicts.select(*columns).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
