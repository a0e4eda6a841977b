"""The scan of a large key where adaptive execution splits skewed partitions of joins."""

from pyspark.sql import functions as F

from sentifold.operators.affine import affine_scan

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
}


def test_stretches_stay_whole_in_split_joins(spark, tmp_path):
    n = 40_000
    # Blocks of the same keys in several files, so that a split by map tasks would part them.
    rows = spark.range(0, n + 400, 1, 16).select(
        F.when(F.col("id") < n, "hot").otherwise("k").alias("k"), F.when(F.col("id") < n, F.col("id")).otherwise(F.col("id") - n).alias("i"),
    ).withColumns({"a": F.lit(1.0), "b": F.lit(1.0)})
    rows.write.parquet(f"{tmp_path}/rows")
    before = {c: spark.conf.get(c, None) for c in CONF}
    try:
        for c, v in CONF.items():
            spark.conf.set(c, v)
        got = affine_scan(spark.read.parquet(f"{tmp_path}/rows"), ["k"], "i", "a", "b", "x", n, 20_000)
        assert got.filter(F.col("x") != F.col("i")).count() == 0  # each row adds one
        assert got.count() == n + 400
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
