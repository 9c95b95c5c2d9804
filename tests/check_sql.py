"""Run registered queries next to their SQL and compare whole results: python tests/check_sql.py [names...]"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(int(v)) if v == int(v) else f"{v:.6g}" if False else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="check-sql-")).getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def compare(spark, con, name, fn, sql, root, verbose=True):
    t = time.time()
    df = fn(spark, root)
    got = rows_of(df.columns, df.collect())
    took = time.time() - t
    if sql is None:
        return (len(got[1]) > 0), f"rows-only {len(got[1])} rows {took:.1f}s"
    t = time.time()
    cur = con.execute(sql)
    want = rows_of([x[0] for x in cur.description], cur.fetchall())
    sql_took = time.time() - t
    ok = got == want
    note = f"{len(got[1])} rows {took:.1f}s sql {sql_took:.1f}s"
    if not ok and verbose:
        if got[0] != want[0]:
            note += f"\n   columns {got[0]} vs {want[0]}"
        a, b = set(got[1]), set(want[1])
        note += f"\n   sql rows {len(want[1])}\n   only spark {sorted(a - b)[:3]}\n   only sql   {sorted(b - a)[:3]}"
    if not got[1]:
        note += "  EMPTY"
    return ok, note


def main(names):
    import duckdb

    import __spark_entry__ as entry
    root = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark, con = session(), duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            ok, note = compare(spark, con, name, fn, sql.get(name), root)
        except Exception as e:
            ok, note = False, "".join(traceback.format_exception_only(e))[:700]
        bad += not ok
        print(("ok  " if ok else "BAD ") + name, note, flush=True)
    print("bad:", bad, "of", len(qs))


if __name__ == "__main__":
    main(sys.argv[1:])
