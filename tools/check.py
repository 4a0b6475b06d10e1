"""Run queries against their SQL on one scale folder.

    python tools/check.py [--sf /root/testdata/sf0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tests.compare import TABLES, compare, make_session  # noqa: E402


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from fenloom.plans import QUERIES, SQL

    spark = make_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t0 = time.time()
        try:
            got = fn(spark, args.sf).toPandas()
            t1 = time.time()
            if name in SQL:
                rel = con.execute(SQL[name])
                want = rel.df()
                t2 = time.time()
                problem = compare(got, want)
            else:
                problem, t2 = None, t1
            state = "ok " if problem is None else "BAD"
            note = "" if name in SQL else " (no SQL)"
            print(f"{state} {name:38s} rows={len(got):7d} spark={t1 - t0:6.2f}s sql={t2 - t1:6.2f}s{note}"
                  + (f"\n    {problem}" if problem else ""), flush=True)
            bad += problem is not None
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"BAD {name}: {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
