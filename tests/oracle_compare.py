"""Run registered queries on Spark and their oracle SQL on DuckDB and
compare: row count, column names, and the multiset of rows (columns sorted
by name, floats compared exactly)."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, dict)):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_norm(r[i]) for i in order) for r in records)


def compare(spark, sf_dir: str, names=None, verbose=True):
    import __spark_entry__ as E

    qs = E.queries()
    sql = E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        srows = [tuple(r) for r in df.collect()]
        scols = df.columns
        t1 = time.time()
        if name not in sql:
            results[name] = ("rows-only", len(srows), None)
            if verbose:
                print(f"{name:28s} rows-only  spark={len(srows)}  {t1 - t0:.2f}s")
            continue
        cur = con.execute(sql[name])
        dcols = [d[0] for d in cur.description]
        drows = cur.fetchall()
        sc, sm = rows_of(scols, srows)
        dc, dm = rows_of(dcols, drows)
        ok = sc == dc and sm == dm
        results[name] = (ok, len(srows), len(drows))
        if verbose:
            flag = "OK " if ok else "BAD"
            print(f"{name:28s} {flag} spark={len(srows)} duck={len(drows)} {t1 - t0:.2f}s")
            if not ok:
                if sc != dc:
                    print("   columns differ:", sc, dc)
                else:
                    only_s = list((sm - dm).elements())[:3]
                    only_d = list((dm - sm).elements())[:3]
                    print("   spark-only:", only_s)
                    print("   duck-only :", only_d)
    return results


if __name__ == "__main__":
    from ledgerlake.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] is False]
    print("BAD:", bad)
