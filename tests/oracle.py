"""Compare every registered query with its SQL: ``python -m tests.oracle [sf] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

from scoreframe.catalog.registry import TABLES

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return str(v)
        return float(f"{v:.9g}") if v != int(v) else int(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def differences(got, want, limit=3) -> str:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    more, less = got[1] - want[1], want[1] - got[1]
    if not more and not less:
        return ""
    return (
        f"{sum(got[1].values())} vs {sum(want[1].values())} rows; only spark: {list(more.items())[:limit]}; "
        f"only sql: {list(less.items())[:limit]}"
    )


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"{DATA}/sf{argv[0] if argv else '0.01'}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in names:
        start = time.time()
        try:
            got = spark_rows(queries[name](spark, sf_dir))
            took = time.time() - start
            n = sum(got[1].values())
            if name not in oracles:
                print(f"rows  {name} {n} rows {took:.2f}s")
                continue
            diff = differences(got, duck_rows(con, oracles[name]))
        except Exception as e:  # noqa: BLE001
            diff, took, n = f"{type(e).__name__}: {str(e)[:1500]}", time.time() - start, 0
        print(f"{'DIFF ' if diff else 'ok   '} {name} {n} rows {took:.2f}s {diff[:2500]}", flush=True)
        if diff:
            bad.append(name)
    print(f"{len(names)} queries, {len(bad)} differ: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
