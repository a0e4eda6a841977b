"""Market tables derived from the given tables (Spark side; ``views`` holds the SQL side)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns used here, declared so that no file is opened to infer them.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# A fill is identified within its symbol by these.
FILL_ORDER = ["ts", "l_orderkey", "l_linenumber"]


class Tables:
    """Lazy DataFrames over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.dir}/{name}.parquet")

    # --- bars and fills -----------------------------------------------------

    @cached_property
    def bars(self) -> DataFrame:
        line, part = self.read("lineitem"), self.read("part")
        first = F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
        )
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        return (
            line.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("day"))
            .agg(
                F.min(first).alias("first"),
                F.max(unit).alias("high"),
                F.min(unit).alias("low"),
                F.sum(cents).alias("cents"),
                F.sum("l_quantity").alias("volume"),
            )
            .select(
                "symbol",
                "day",
                (F.col("first.l_extendedprice") / F.col("first.l_quantity")).alias("open"),
                "high",
                "low",
                (F.col("cents") / 100.0 / F.col("volume")).alias("close"),
                "volume",
                (F.col("cents") / 100.0).alias("amount"),
            )
        )

    @cached_property
    def fills(self) -> DataFrame:
        side = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
        qty = F.col("l_quantity").cast("bigint")
        return self.read("lineitem").select(
            F.col("l_partkey").cast("string").alias("symbol"),
            F.col("l_shipdate").alias("ts"),
            F.to_date("l_shipdate").alias("day"),
            "l_orderkey",
            "l_linenumber",
            side.alias("side"),
            F.col("l_quantity").alias("quantity"),
            F.when(F.col("l_returnflag") == "R", -qty).otherwise(qty).alias("qty"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        )

    @cached_property
    def last_price(self) -> DataFrame:
        return self.fills.groupBy("symbol").agg(F.max_by("price", F.struct(*FILL_ORDER)).alias("price"))

    # --- sentiment ----------------------------------------------------------

    @cached_property
    def sentiment_raw(self) -> DataFrame:
        kind = F.col("event_type")
        source = (
            F.when(kind == "purchase", "news")
            .when(kind == "click", "social")
            .when(kind == "view", "search")
            .when(kind == "signup", "forum")
            .otherwise("other")
        )
        return self.read("events").select(
            F.col("user_id").cast("string").alias("symbol"),
            "ts",
            "event_id",
            source.alias("source"),
            F.greatest(F.least(1 - F.col("value") / 50, F.lit(1.0)), F.lit(-1.0)).alias("score"),
            (0.5 + (F.col("event_id") % 50) / 100.0).alias("confidence"),
        )

    @cached_property
    def composite(self) -> DataFrame:
        from sentifold.plans.mood import daily_composite

        return daily_composite(self.sentiment_raw, ["ts", "event_id"])

    @cached_property
    def mood(self) -> DataFrame:
        from sentifold.plans.mood import mood_series

        return mood_series(self.sentiment_raw, ["ts", "event_id"])

    @cached_property
    def brand_mood(self) -> DataFrame:
        """Daily totals for the symbols of ``bars``, moved to January 2001."""
        from sentifold.operators.blend import total_score

        raw = self.sentiment_raw.withColumn(
            "symbol", F.concat(F.lit("Brand#"), (1 + F.col("symbol").cast("bigint") % 25).cast("string"))
        ).withColumn("day", F.date_sub(F.to_date("ts"), 8400))
        return total_score(raw, ["symbol", "day"], ["ts", "event_id"]).select(
            "symbol", "day", F.col("total").alias("score")
        )

    # --- vendor tables ------------------------------------------------------

    def vendor(self) -> dict[str, DataFrame]:
        part, line, cust = self.read("part"), self.read("lineitem"), self.read("customer")
        k = F.col("p_partkey")
        # Padded to six digits, never cut to them: longer keys would share a code.
        six = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(6), F.length(c.cast("string"))), "0")
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        net = F.sum(F.when(F.col("l_returnflag") == "R", -cents).otherwise(cents)) / 100.0
        per_part = line.groupBy("l_partkey").agg(
            net.alias("net"), F.sum(F.col("l_tax") * F.col("l_extendedprice")).alias("tax")
        )
        code = six(F.col("l_partkey"))
        balance = F.floor(F.abs("c_acctbal") * 2000).cast("bigint")
        thousands = F.floor(balance / 1000).cast("bigint")
        text = F.concat(
            thousands.cast("string"), F.lit(","), F.lpad((balance - thousands * 1000).cast("string"), 3, "0")
        )
        margin = lambda header, parity: cust.filter(F.col("c_custkey") % 2 == parity).select(
            six(F.col("c_custkey")).alias(header), text.alias("融资余额")
        )
        return {
            "hot_rank": part.filter(k % 3 != 1).select(
                F.concat(F.when(k % 2 == 0, "SH").otherwise("SZ"), six(k)).alias("代码"), k.alias("rank")
            ),
            "spot": part.select(
                six(k).alias("代码"),
                (k % 11 - 5).cast("double").alias("涨跌幅"),
                (F.col("p_size") * 400000).cast("double").alias("成交量"),
            ),
            "dragon_tiger": per_part.filter(F.col("l_partkey") % 2 == 0).select(
                code.alias("代码"), F.col("net").alias("龙虎榜净买额")
            ),
            "northbound": part.filter(k % 5 != 0).select(
                six(k).alias("股票代码"), F.concat((k % 13 - 6).cast("string"), F.lit("%")).alias("持股变动")
            ),
            "fund_flow": per_part.select(
                code.alias("代码"), F.col("net").alias("主力净流入"), F.col("tax").alias("散户净流入")
            ),
            "margin_a": margin("标的证券代码", 0),
            "margin_b": margin("证券代码", 1),
        }

    # --- companies ----------------------------------------------------------

    @cached_property
    def fundamentals(self) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size")
        eps = F.col("p_retailprice") / size
        return self.read("part").select(
            k.cast("string").alias("symbol"),
            F.lit("2001-01-01").cast("timestamp_ntz").alias("ts"),
            F.col("p_brand").alias("sector"),
            F.when(size % 10 != 0, size.cast("double")).alias("pe_ratio"),
            (size + 1).cast("double").alias("pe_ttm"),
            ((k % 40) / 10.0).alias("pb_ratio"),
            ((k % 7) / 100.0).alias("dividend_yield"),
            F.when(k % 5 != 0, size / 20.0).alias("peg_ratio"),
            F.when(k % 11 == 0, -eps).otherwise(eps).alias("eps"),
            (F.col("p_retailprice") / 10).alias("book_value_per_share"),
            ((k % 30) / 100.0).alias("roe"),
        )

    @cached_property
    def reports(self) -> DataFrame:
        """Four quarterly snapshots per company with drifting multiples."""
        base = self.fundamentals.withColumn("quarter", F.explode(F.sequence(F.lit(0), F.lit(3))))
        k, q = F.col("symbol").cast("bigint"), F.col("quarter")
        return base.withColumns(
            {
                "ts": F.expr("cast(date_add(date'2000-03-31', quarter * 91) as timestamp_ntz)"),
                "pe_ratio": F.col("pe_ratio") + (k * q) % 7,
                "pb_ratio": F.col("pb_ratio") + q / 10.0,
            }
        )

    @cached_property
    def names(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.read("part").filter(k % 3 != 0).select(
            k.cast("string").alias("symbol"), F.col("p_name").alias("name")
        )

    # --- positions, requests, signals, equity -------------------------------

    @cached_property
    def held(self) -> DataFrame:
        """Held entries with stop and target, around the last price."""
        part = self.read("part").filter(F.col("p_partkey") % 4 == 0).select("p_partkey")
        k = F.col("p_partkey")
        long = F.floor(k / 4) % 2 == 0
        e = F.col("entry_price")
        return (
            part.withColumn("symbol", k.cast("string"))
            .join(self.last_price, "symbol")
            .withColumn("entry_price", F.col("price") * (1 + (k % 41 - 20) / 100.0))
            .select(
                "symbol",
                F.when(long, "BUY").otherwise("SELL").alias("entry_type"),
                "entry_price",
                F.when(long, e * 0.92).otherwise(e * 1.08).alias("stop_loss"),
                F.when(long, e * 1.15).otherwise(e * 0.85).alias("take_profit"),
            )
        )

    @cached_property
    def positions(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.read("part").filter(k % 3 == 0).select(
            k.cast("string").alias("symbol"),
            ((k % 60 - 9) * 100).cast("bigint").alias("quantity"),
            F.col("p_retailprice").alias("avg_cost"),
            (F.col("p_retailprice") * (1 + (k % 25 - 12) / 100.0)).alias("current_price"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        o, c = self.read("orders"), self.read("customer")
        kind = F.substring("o_orderpriority", 1, 1)
        key, total = F.col("o_orderkey"), F.col("o_totalprice")
        kind_name = (
            F.when(kind == "2", "limit").when(kind == "3", "stop").when(kind == "4", "stop_limit").otherwise("market")
        )
        return o.join(c.select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey")).select(
            key.alias("request_id"),
            F.when(key % 97 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("symbol"),
            F.when(F.col("o_orderstatus") == "O", "buy").otherwise("sell").alias("side"),
            kind_name.alias("order_type"),
            (key % 200 - 3).cast("bigint").alias("quantity"),
            F.when(kind.isin("2", "4") & (key % 7 != 0), total / 1000).alias("price"),
            F.when(kind.isin("3", "4") & (key % 9 != 0), total / 1000 - 2).alias("stop_price"),
            (F.col("c_acctbal") * 4).alias("balance"),
        )

    @cached_property
    def signals(self) -> DataFrame:
        """One signal per day, symbol and strategy."""
        e = F.col("id")
        side = F.when(e % 10 == 0, "EXIT_LONG").when(e % 3 == 0, "SELL").otherwise("BUY")
        up = F.col("signal_type") != "SELL"
        entry = F.col("entry_price")
        return (
            self.read("events")
            .groupBy(
                F.to_date("ts").alias("run"),
                F.col("user_id").cast("string").alias("symbol"),
                F.col("event_type").alias("source"),
            )
            .agg(
                F.max("event_id").alias("id"),
                F.max("value").alias("top"),
                F.min("value").alias("low"),
                F.max("ts").alias("ts"),
            )
            .withColumns(
                {
                    "signal_type": side,
                    "strength": F.least(F.lit(100.0), F.col("top")),
                    "confidence": 0.2 + (e % 80) / 100.0,
                    "entry_price": (10 + e % 90).cast("double"),
                }
            )
            .select(
                "run",
                "symbol",
                "signal_type",
                "ts",
                "source",
                "strength",
                "confidence",
                "entry_price",
                F.when(e % 5 != 0, F.when(up, entry * 0.92).otherwise(entry * 1.08)).alias("stop_loss"),
                F.when(e % 5 != 0, F.when(up, entry * 1.15).otherwise(entry * 0.85)).alias("take_profit"),
                F.when(e % 11 == 0, 0.03).alias("position_size"),
                F.lit(None).cast("bigint").alias("quantity"),
                (F.col("low") / 50 - 1).alias("sentiment_score"),
                F.when(e % 4 != 0, (e % 21 - 10) / 20.0).alias("valuation_score"),
                F.lit(None).cast("double").alias("price_z_score"),
                F.lit(None).cast("double").alias("dislocation"),
                F.array(F.concat(F.lit("reason "), (e % 3).cast("string"))).alias("reasons"),
                F.create_map().cast("map<string,string>").alias("metadata"),
            )
        )

    @cached_property
    def equity(self) -> DataFrame:
        """A wandering curve from the daily order totals: 1e9 plus the sum of their departures from the mean."""
        from pyspark.sql import Window

        daily = self.read("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
            F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")
        )
        mean = daily.agg((F.sum("cents") / F.count(F.lit(1))).alias("m")).scalar()
        w = Window.partitionBy("curve").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        curve = daily.withColumn("curve", F.lit(0))
        sums = curve.withColumn("cum", F.sum("cents").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
        return sums.select("date", (1e9 + (F.col("cum") - F.col("n") * mean) / 100.0).alias("equity"))
