"""Run registered queries in Spark and their SQL twins in DuckDB and compare (values sorted, columns by name).

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName("check")
         .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.extraJavaOptions", "-Dlog4j2.level=ERROR").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def duck(sf):
    import duckdb
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, dict):
        return str({k: norm(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def compare(spark, con, name, fn, text, sf):
    t0 = time.time()
    df = fn(spark, sf)
    rows = df.collect()
    t1 = time.time()
    if text is None:
        return f"ROWS {len(rows)}", t1 - t0, 0.0
    rel = con.execute(text)
    dcols = [d[0] for d in rel.description]
    dtypes = dict(zip(dcols, [str(d[1]) for d in rel.description]))
    drows = rel.fetchall()
    t2 = time.time()
    cols = sorted(df.columns)
    if cols != sorted(dcols):
        return f"FAIL columns {cols} vs {sorted(dcols)}", t1 - t0, t2 - t1
    bad = [f"{c}:{t}/{dtypes[c]}" for c, t in df.dtypes if KIND.get(t, "?") not in ("?", dtypes[c])]
    a = sorted(tuple(norm(r[c]) for c in cols) for r in rows)
    ix = [dcols.index(c) for c in cols]
    b = sorted(tuple(norm(r[i]) for i in ix) for r in drows)
    if len(a) != len(b):
        ex = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"FAIL rows {len(a)} vs {len(b)} cols {cols} e.g. {ex}", t1 - t0, t2 - t1
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        sa, sb = set(a), set(b)
        return (f"FAIL {len(diff)} of {len(a)} differ; cols {cols}; spark-only {[x for x in a if x not in sb][:2]}; "
                f"duck-only {[x for x in b if x not in sa][:2]}"), t1 - t0, t2 - t1
    return f"ok {len(a)}" + (f" TYPES {bad}" if bad else ""), t1 - t0, t2 - t1


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    spark, con = session(), duck(a.sf)
    names = a.names or list(q)
    picked = [n for n in q if any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in names)]
    bad = 0
    for n in picked:
        try:
            msg, ts, td = compare(spark, con, n, q[n], o.get(n), a.sf)
        except Exception as ex:
            msg, ts, td = f"ERROR {type(ex).__name__}: {str(ex)[:700]}", 0, 0
        bad += not (msg.startswith("ok") or msg.startswith("ROWS")) or "TYPES" in msg
        print(f"{n:28s} {ts:6.2f}s duck {td:5.2f}s  {msg}", flush=True)
    print(f"{len(picked)} checked, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
