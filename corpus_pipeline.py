"""A corpus in stages: each stage works on all rows its predecessor kept.

Every stage but the last returns its input's columns, whatever they are called.  Null texts count as empty: the quality rules turn them
away.  Repeated rows are copies, one of which stays; a null id comes last among copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentifold.llm import decontam, packing, quality, resemblance, suffixes
from sentifold.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the rules' posterior keeps."""
    rows = docs.select(F.struct(*docs.columns).alias("doc_"), "text")  # so that no column meets one of the rules'
    return quality.judged(rows).filter("kept").select("doc_.*")


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group connected by 0.8 or more of their five-word shingles in common, found by SimHash and by MinHash."""
    return resemblance.one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents less every copy of a passage but its first, with their new number of characters where they state it."""
    cut = suffixes.without_copies(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]

# Weak supervision, connected groups, suffix order and a packing search have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over `documents`, every stage's rows written before the next reads them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
