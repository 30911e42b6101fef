"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]

Compares row count, column names and the multiset of rows (columns sorted by
name). Floats must match exactly; a second, tolerant comparison is reported
when the exact one fails, to tell rounding apart from logic errors.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_conn(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, tol):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6) if tol else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, records, tol=False):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i], tol) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name, q, sf_dir):
    t0 = time.time()
    df = q.run(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t_spark = time.time() - t0
    if q.oracle is None:
        return dict(name=name, ok=None, rows=len(s_rows), spark_s=round(t_spark, 2))
    res = con.execute(q.oracle)
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    info = dict(name=name, rows=len(s_rows), oracle_rows=len(o_rows), spark_s=round(t_spark, 2))
    if sorted(s_cols) != sorted(o_cols):
        info.update(ok=False, why=f"columns {s_cols} vs {o_cols}")
        return info
    exact = rows_of(s_cols, s_rows) == rows_of(o_cols, o_rows)
    if exact:
        info.update(ok=True)
        return info
    tol = rows_of(s_cols, s_rows, True) == rows_of(o_cols, o_rows, True)
    info.update(ok=False, why="values differ" + (" (equal within 1e-6)" if tol else ""))
    a, b = rows_of(s_cols, s_rows), rows_of(o_cols, o_rows)
    diff = [r for r in a if r not in b][:3]
    info["spark_only"] = diff
    info["oracle_only"] = [r for r in b if r not in a][:3]
    return info


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    from rankspark.registry import load_all
    from rankspark.session import local_session

    spark = local_session(8, checkpoint_dir="file://" + tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    con = duck_conn(args.sf)
    reg = load_all()
    names = args.names or list(reg)
    bad = 0
    for n in names:
        try:
            info = compare(spark, con, n, reg[n], args.sf)
        except Exception as e:  # report and go on
            info = dict(name=n, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        bad += info.get("ok") is False
        print(info, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
