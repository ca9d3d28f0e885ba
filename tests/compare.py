"""Run registered queries on Spark and DuckDB and compare whole results.

Usage: python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def rows(names: list[str], values) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in values)


def differences(spark, connection, name: str, sf_dir: str):
    """(missing on Spark, extra on Spark, Spark rows, column problem)."""
    frame = entry.queries()[name](spark, sf_dir)
    result = connection.execute(entry.oracle_sql()[name])
    names = [column[0] for column in result.description]
    expected = rows(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return expected, Counter(), 0, f"columns {sorted(frame.columns)} <> {sorted(names)}"
    found = rows(frame.columns, [tuple(row) for row in frame.collect()])
    return expected - found, found - expected, sum(found.values()), None


def main() -> None:
    sf_dir, *wanted = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    connection = tables(sf_dir)
    for name in wanted or entry.queries():
        if name not in entry.oracle_sql():
            print(f"{name:26s} no SQL counterpart")
            continue
        start = time.time()
        try:
            missing, extra, count, problem = differences(spark, connection, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            print(f"{name:26s} FAIL {str(error)[:500]}", flush=True)
            continue
        good = not missing and not extra and not problem
        print(f"{name:26s} {'ok  ' if good else 'DIFF'} {count:7d} rows {time.time() - start:6.2f}s", flush=True)
        if not good:
            print("   ", problem or "", len(missing), len(extra))
            for side, counter in (("sql  ", missing), ("spark", extra)):
                for row in sorted(counter, key=str)[:2]:
                    print("   ", side, str(row)[:700])


if __name__ == "__main__":
    main()
