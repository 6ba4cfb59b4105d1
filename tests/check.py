"""Compare registered queries with their SQL on one data directory.

Run as ``python tests/check.py [--sf DIR] [name ...]``; also imported by the oracle test.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from creditloom.workload import all_oracles, all_queries
from creditloom.workload.base import TABLES


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("creditloom-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def cell(x):
    if x is None or x is pd.NaT:
        return None
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return 0.0 if x == 0 else x
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return tuple(cell(i) for i in x)
    if isinstance(x, dict):
        return tuple(sorted((k, cell(i)) for k, i in x.items()))
    if hasattr(x, "item"):
        return cell(x.item())
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime()
    return x


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [columns[i] for i in order], out


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str, float]:
    start = time.time()
    df = all_queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    sql = all_oracles().get(name)
    if sql is None:
        return len(rows) > 0, f"rows-only {len(rows)}", took
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    cols, got = normal(rows, df.columns)
    wcols, exp = normal(want, want_cols)
    if cols != wcols:
        return False, f"columns {set(cols) ^ set(wcols)}", took
    if len(got) != len(exp):
        return False, f"rows {len(got)} against {len(exp)}", took
    bad = [(g, e) for g, e in zip(got, exp) if g != e]
    kinds = ""
    for i, c in enumerate(cols):
        a = {type(r[i]).__name__ for r in got if r[i] is not None}
        b = {type(r[i]).__name__ for r in exp if r[i] is not None}
        if a != b:
            kinds += f" type {c}: {a} against {b};"
    if bad:
        g, e = bad[0]
        diff = {c: (x, y) for c, x, y in zip(cols, g, e) if x != y}
        return False, f"{len(bad)} of {len(got)} rows differ, first {str(diff)[:300]}{kinds}", took
    return not kinds, f"{len(got)} rows{kinds}", took


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark, con = session(), duck(args.sf)
    names = args.names or list(all_queries())
    failed = []
    for name in names:
        if name.endswith("*"):
            continue
        try:
            ok, note, took = compare(spark, con, name, args.sf)
        except Exception as exc:
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.2f}s {name}: {note}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
