"""Run every registered query in Spark and its SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per query: rows, column names, value multiset.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v.normalize()))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    from __spark_entry__ import oracle_sql, queries
    from fleetlake.session import local_session
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for k, fn in qs.items():
        if only and k not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            scols = df.columns
            stypes = [f.dataType.simpleString() for f in df.schema.fields]
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"NOSQL {k}: rows={len(srows)} ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(sqls[k])
            dcols = [d[0] for d in cur.description]
            dtypes = [str(d[1]) for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:
            print(f"FAIL {k}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        probs = []
        if sorted(scols) != sorted(dcols):
            probs.append(f"cols spark-only={sorted(set(scols)-set(dcols))} duck-only={sorted(set(dcols)-set(scols))}")
        if len(srows) != len(drows):
            probs.append(f"rows {len(srows)} vs {len(drows)}")
        if not probs:
            a, b = canon(scols, srows), canon(dcols, drows)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                probs.append(f"values differ e.g. {diff}")
        tmap = dict(zip(dcols, dtypes))
        types = ", ".join(f"{c}:{t}/{tmap.get(c)}" for c, t in zip(scols, stypes))
        if probs:
            bad += 1
            print(f"FAIL {k}: {'; '.join(probs)[:1500]}\n     types {types[:600]}")
        else:
            print(f"OK   {k}: rows={len(srows)} ({ts:.1f}s) types {types[:300]}")
    print(f"done, {bad} failing")


if __name__ == "__main__":
    main()
