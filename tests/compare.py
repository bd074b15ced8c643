"""Run registered queries in Spark and their SQL in DuckDB on the same tables, and compare rows."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from runloom.session import build  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DATA = os.environ.get("RUNLOOM_TESTDATA", "/root/testdata")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}" if isinstance(value, float) and value != int(value) else str(int(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name: str, folder: str) -> tuple[str, float]:
    began = time.time()
    df = entry.queries()[name](spark, folder)
    got, names = rows_of(df.columns, df.collect())
    took = time.time() - began
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got)}", took
    result = con.execute(sql)
    want, wanted = rows_of([d[0] for d in result.description], result.fetchall())
    if names != wanted:
        return f"DIFFERENT columns {names} / {wanted}", took
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return f"DIFFERENT {len(got)} / {len(want)} rows\n   spark  {only_got}\n   duckdb {only_want}", took
    return f"same {len(got)}", took


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build("compare", "local[8]", **{"spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"{DATA}/sf{args.sf}"
    con = connect(folder)
    bad = 0
    for name in args.names or entry.queries():
        try:
            verdict, took = compare(spark, con, name, folder)
        except Exception as error:
            verdict, took = "ERROR " + str(error)[:700], 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not verdict.startswith(("same", "rows only"))
        print(f"{name:24s} {took:6.2f}s  {verdict}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
