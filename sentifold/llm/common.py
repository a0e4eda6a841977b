"""What the operators share: written intermediate tables, row numbers, and Arrow batches of a modest size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentifold.operators.durable import shared_folder

# Rows per Arrow batch: a thousand documents of some kilobytes are a few megabytes.
BATCH_ROWS = 1000


def modest_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Texts may be long, so a batch for Python holds fewer rows than Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared folder: a lost executor costs a re-read, every reader sees one copy."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: Column) -> Column:
    """A text's bytes, a null text's being empty."""
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
