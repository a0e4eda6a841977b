"""Compare registered queries with their SQL: ``python -m checks.run [folder] [name-part ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from . import all_cases
from .tables import Tables

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda x: "NULL" if x is None or x is pd.NA or x != x else (
        repr(float(x)) if isinstance(x, float) else str(x))
    return sorted(tuple(cell(x) for x in row) for row in df.itertuples(index=False))


SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def compare(got, answer) -> str | None:
    """A Spark DataFrame against a DuckDB answer.  Columns whose declared types agree may differ in pandas, as all-null ones do."""
    columns = dict(zip(answer.columns, map(str, answer.types), strict=True))
    declared = {c for c, kind in got.dtypes if SAME.get(kind, kind.upper()) == columns.get(c)}
    return differ(got.toPandas(), answer.df(), declared)


def differ(left: pd.DataFrame, right: pd.DataFrame, declared: set[str] = frozenset()) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    kinds = [(c, str(left[c].dtype), str(right[c].dtype)) for c in left.columns]
    odd = [k for k in kinds if k[1] != k[2] and k[0] not in declared and {k[1], k[2]} - {"object", "str", "string"}]
    a, b = _canon(left), _canon(right)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {sorted(left.columns)}\n   {bad[0][0]}\n   {bad[0][1]}"
    return f"types {odd}" if odd else None


def main(folder: str, parts: list[str]) -> int:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for case in all_cases():
        if parts and not any(p in case.name or p in case.build.__module__ for p in parts):
            continue
        start = time.time()
        try:
            rows = case.build(Tables(spark, folder))
            verdict = compare(rows, con.sql(case.sql)) if case.sql else f"no sql, {rows.count()} rows"
        except Exception as e:  # noqa: BLE001
            verdict = f"{type(e).__name__}: {str(e)[:1500]}"
        took = time.time() - start
        ok = verdict is None or verdict.startswith("no sql")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {case.name:32s} {took:6.2f}s {verdict or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) else 0)
