"""Run every registered query in Spark and its oracle SQL in DuckDB on one
test scale and compare row counts, column names and values.

usage: python tools/oracle_check.py [sf_dir] [name ...]
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

from fleetscope import registry  # noqa: E402
from fleetscope.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(float(v))
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir, show=5):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(canon(r[c]) for c in sorted(s_cols)) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = rel.columns
    idx = {c: i for i, c in enumerate(d_cols)}
    d_rows = [tuple(canon(r[idx[c]]) for c in sorted(d_cols)) for r in rel.fetchall()]
    if sorted(s_cols) != sorted(d_cols):
        return f"COLUMNS spark-only={sorted(set(s_cols) - set(d_cols))} oracle-only={sorted(set(d_cols) - set(s_cols))}"
    if len(s_rows) != len(d_rows):
        msg = f"ROWCOUNT spark={len(s_rows)} oracle={len(d_rows)}"
    else:
        msg = None
    a, b = sorted(s_rows), sorted(d_rows)
    if a == b:
        return f"ok rows={len(a)} spark={t1 - t0:.1f}s"
    sa, sb = set(a), set(b)
    only_s = [r for r in a if r not in sb][:show]
    only_d = [r for r in b if r not in sa][:show]
    cols = sorted(s_cols)
    lines = [msg or f"VALUES differ rows={len(a)}"]
    for r in only_s:
        lines.append("  spark : " + str(dict(zip(cols, r))))
    for r in only_d:
        lines.append("  oracle: " + str(dict(zip(cols, r))))
    return "\n".join(lines)


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = local_session(8, 8)
    con = duck(sf_dir)
    qs, sqls = registry.queries(), registry.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            n = qs[name](spark, sf_dir).count()
            print(f"{name}: no oracle, rows={n}")
            continue
        try:
            res = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as e:  # report and go on
            res = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        if not res.startswith("ok"):
            bad += 1
        print(f"{name}: {res}", flush=True)
    print(f"mismatches: {bad}")


if __name__ == "__main__":
    main()
