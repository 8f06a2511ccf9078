"""Run registered queries next to their oracle SQL and report differences.

    python tests/oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0 if v else 0.0)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        v = v.replace(tzinfo=None)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql, loose=False):
    cols = spark_df.columns
    got = rows_of(cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    want = rows_of(ocols, cur.fetchall())
    if sorted(cols) != sorted(ocols):
        return f"columns {sorted(cols)} vs {sorted(ocols)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; only spark {sorted(set(got) - set(want))[:2]} only oracle {sorted(set(want) - set(got))[:2]}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, cols {sorted(cols)}\n   spark  {bad[0][0]}\n   oracle {bad[0][1]}", len(got)
    types = dict(spark_df.dtypes)
    return None, len(got)


def main(sf_dir="/root/testdata/sf0.01", *names):
    from strikelake.session import build_session
    import __spark_entry__ as entry

    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                msg, n = compare(df, con, sqls[name])
            else:
                msg, n = None, df.count()
        except Exception as exc:  # report and go on
            msg, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        took = time.time() - t0
        tag = "FAIL" if msg else ("ok" if name in sqls else "rows")
        failed += bool(msg)
        print(f"{tag:5s}{took:6.2f}s {n:8d} {name} {msg or ''}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
