"""Run a card in Spark and its oracle in DuckDB, compare like the driver does:
row count, column names, and an order-insensitive hash of the values.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


STRICT = os.environ.get("STRICT", "0") == "1"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return (f if STRICT else round(f, 6)) + 0.0
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))
    return [cols[i] for i in order], out


def digest(rows) -> str:
    h = hashlib.sha256()
    for r in rows:
        h.update(repr(r).encode())
    return h.hexdigest()[:16]


def compare(spark, sf_dir: str, keys=None, verbose=True):
    import __spark_entry__ as se

    qs, sql = se.queries(), se.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for key in keys or list(qs):
        t0 = time.time()
        df = qs[key](spark, sf_dir)
        srows = [tuple(r) for r in df.collect()]
        scols = df.columns
        t1 = time.time()
        if key not in sql:
            results[key] = {"rows": len(srows), "oracle": None}
            if verbose:
                print(f"{key:32s} spark_rows={len(srows):7d} (no oracle) {t1 - t0:.1f}s", flush=True)
            continue
        res = con.execute(sql[key])
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        sc, sr = canon(srows, scols)
        oc, orr = canon(orows, ocols)
        ok = sc == oc and len(sr) == len(orr) and digest(sr) == digest(orr)
        results[key] = {"rows": len(srows), "oracle_rows": len(orows), "match": ok}
        if verbose:
            print(
                f"{key:32s} spark_rows={len(srows):7d} oracle_rows={len(orows):7d} "
                f"cols_ok={sc == oc} match={ok} {t1 - t0:.1f}s",
                flush=True,
            )
            if not ok:
                if sc != oc:
                    print("   spark cols", sc, "\n   oracle cols", oc)
                diff_s = [r for r in sr if r not in set(orr)][:3]
                diff_o = [r for r in orr if r not in set(sr)][:3]
                print("   spark-only", diff_s, "\n   oracle-only", diff_o)
    return results


if __name__ == "__main__":
    from segmenta.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, keys)
    bad = [k for k, v in res.items() if v.get("match") is False]
    print("MISMATCH:", bad)
