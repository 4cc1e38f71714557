"""Run registered queries next to their SQL twins and compare row by row.

    python tests/compare.py <sf_dir> [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    conn = duckdb.connect()
    conn.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        conn.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return conn


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return "" if value is None else repr(value)


def normalised(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, sql: str, conn) -> list[str]:
    found = df.collect()
    cursor = conn.execute(sql)
    names = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if len(found) != len(expected):
        problems.append(f"rows {len(found)} != {len(expected)}")
    left, right = normalised(df.columns, found), normalised(names, expected)
    if left != right:
        gone, extra = set(right) - set(left), set(left) - set(right)
        problems.append(f"columns {sorted(names)}")
        problems += [f"  only SQL:   {r}" for r in sorted(gone)[:2]] + [f"  only Spark: {r}" for r in sorted(extra)[:2]]
    if not found:
        problems.append("no rows")
    return problems


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    conn, oracles, bad = oracle_connection(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            problems = differences(build(spark, sf_dir), oracles[name], conn) if name in oracles else ["no SQL twin"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'DIFF' if problems else 'ok  '} {name} {time.time() - began:.1f}s", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{bad} of the queries differ")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
