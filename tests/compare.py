"""Run registered queries against DuckDB.  ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import threading
import time

import duckdb

ROOT = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    return con


def _key(row):
    return tuple("~" if v is None or v != v else (f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def _same(a, b) -> bool:
    for x, y in zip(a, b):
        xn, yn = x is None or x != x, y is None or y != y
        if xn or yn:
            if xn != yn:
                return False
        elif isinstance(x, float) or isinstance(y, float):
            if abs(x - y) > 2e-6 + 1e-9 * abs(y):
                return False
        elif x != y:
            return False
    return True


def compare(q, spark, con, sf_dir: str):
    """(ok, exact, rows, message)"""
    df = q.frame(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if q.sql is None:
        return True, True, len(rows), "rows only"
    want = con.execute(q.oracle()).fetchall()
    if len(rows) != len(want):
        return False, False, len(rows), f"rows {len(rows)} vs {len(want)}; {rows[:1]} {want[:1]}"
    got_s, want_s = sorted(rows, key=_key), sorted(want, key=_key)
    exact = sorted(map(repr, rows)) == sorted(map(repr, want))
    bad = [(a, b) for a, b in zip(got_s, want_s) if not _same(a, b)]
    return not bad, exact, len(rows), "" if not bad else f"{len(bad)} differ\n   got  {bad[0][0]}\n   want {bad[0][1]}"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from barloom.plans import REGISTRY
    from barloom.session import local_session

    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(REGISTRY)
    names = [n for n in REGISTRY if any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in names)]
    sf_dir = f"{ROOT}/sf{sf}"
    con, spark = connect(sf_dir), local_session()
    fails = 0
    for n in names:
        t = time.time()
        stop = threading.Timer(float(os.environ.get("QUERY_LIMIT", "60")), spark.sparkContext.cancelAllJobs)
        stop.start()
        try:
            ok, exact, rows, msg = compare(REGISTRY[n], spark, con, sf_dir)
        except Exception as e:  # report and go on
            ok, exact, rows, msg = False, False, -1, f"{type(e).__name__}: {str(e)[:900]}"
        stop.cancel()
        fails += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {'=' if exact else '~'} {n:38s} rows={rows:<7d} {time.time() - t:5.1f}s {msg}", flush=True)
    print(f"{len(names) - fails}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
