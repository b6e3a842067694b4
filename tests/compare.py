"""Run registered queries in Spark and their SQL in DuckDB, and compare values.

    python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql) -> str | None:
    """None when both results are the same, else what differs."""
    cur = con.execute(sql)
    want_cols, want = _table([c[0] for c in cur.description], cur.fetchall())
    got_cols, got = _table(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = list(set(map(repr, got)) - set(map(repr, want)))[:3]
        missing = list(set(map(repr, want)) - set(map(repr, got)))[:3]
        return f"rows {len(got)} != {len(want)}; only in Spark {extra}; only in SQL {missing}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {g} != {w}"
    return None


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, checks = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in checks:
                diff = difference(df, con, checks[name])
                rows = con.execute(f"SELECT count(*) FROM ({checks[name]})").fetchall()[0][0]
            else:
                diff, rows = None, df.count()
            word = "ok" if diff is None else "DIFF"
        except Exception as e:  # noqa: BLE001
            diff, word, rows = str(e)[:1500], "FAIL", -1
        bad += word != "ok"
        print(f"{word:5} {name:45} {'sql ' if name in checks else 'rows'} {rows:7} {time.time() - start:6.1f}s {diff or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
