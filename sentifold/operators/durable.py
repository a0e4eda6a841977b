"""Cutting a plan at a written copy, so that a lost executor costs a re-read and not a re-run."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local session may fall back to its own folder."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="sentifold-")
    spark.conf.set(SETTING, folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Materialise once into the shared folder; every later branch reads that same copy."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
