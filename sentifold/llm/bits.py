"""A bit table of fixed size from numbers of any count, made by grouped ors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 64-bit words that reach the driver as one value.
CHUNK = 4096


def _chunk(rows: pd.DataFrame) -> pd.DataFrame:
    words = np.zeros(CHUNK, np.int64)
    words[rows["at"].to_numpy() % CHUNK] = rows["mark"].to_numpy()
    return pd.DataFrame({"chunk": [int(rows["chunk"].iloc[0])], "words": [words.tobytes()]})


def bit_table(numbers: DataFrame, column: str, bits: int) -> np.ndarray:
    """2 ** bits bits as 64-bit words, set where a number occurs; what reaches the driver is as large at most."""
    number = F.col(column)
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(63).cast("int"))
    rows = numbers.select(F.shiftright(number, 6).alias("at"), mark.alias("mark"))
    rows = rows.groupBy("at").agg(F.bit_or("mark").alias("mark")).withColumn("chunk", F.floor(F.col("at") / CHUNK))
    chunks = rows.groupBy("chunk").applyInPandas(_chunk, "chunk long, words binary")
    table = np.zeros(max(1 << max(bits - 6, 0), CHUNK), np.uint64)
    for r in chunks.toLocalIterator():
        table[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["words"], np.uint64)
    return table


def is_set(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return (table[numbers >> 6] >> (numbers & 63).astype(np.uint64)) & np.uint64(1) == 1
