"""Compare every ``queries()`` key with its DuckDB oracle on one scale factor.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key and exits non-zero on any mismatch.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    return v


def rows_of(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, sf_dir: str, keys=None) -> list[str]:
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = []
    for key in keys or list(qs):
        t0 = time.time()
        sdf = qs[key](spark, sf_dir)
        s_rows = [r.asDict() for r in sdf.collect()]
        t1 = time.time()
        if key not in sql:
            print(f"{key:28s} spark={len(s_rows):6d} (no oracle) {t1 - t0:6.2f}s")
            continue
        rel = con.sql(sql[key])
        cols = rel.columns
        d_rows = [dict(zip(cols, r)) for r in rel.fetchall()]
        ok_cols = sorted(cols) == sorted(sdf.columns)
        same = ok_cols and rows_of(s_rows, sorted(cols)) == rows_of(d_rows, sorted(cols))
        print(f"{key:28s} spark={len(s_rows):6d} duck={len(d_rows):6d} "
              f"{'OK ' if same else 'BAD'} {t1 - t0:6.2f}s")
        if not same:
            bad.append(key)
            if ok_cols:
                a = rows_of(s_rows, sorted(cols))
                b = rows_of(d_rows, sorted(cols))
                diff_a = [r for r in a if r not in set(b)][:3]
                diff_b = [r for r in b if r not in set(a)][:3]
                print("   cols", sorted(cols))
                print("   spark-only", diff_a)
                print("   duck-only ", diff_b)
            else:
                print("   columns differ", sdf.columns, cols)
    return bad


if __name__ == "__main__":
    from assetlens.session import local_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    keys = sys.argv[2:] or None
    spark = local_session()
    bad = compare(spark, sf_dir, keys)
    print("MISMATCH:", bad if bad else "none")
    sys.exit(1 if bad else 0)
