"""Run registered queries and their SQL side by side (python -m tests.oracle_check [sf] [name part ...])."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def sql_connection(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (int, str)):
        return v
    return float(v) if hasattr(v, "as_tuple") else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql: str) -> str:
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)
           and not all(a == b or (type(a) in (int, float) and type(b) in (int, float) and a == b)
                       for a, b in zip(g, w))]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ, first\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    return f"ok {len(got)}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(0) if args else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = sql_connection(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(a in n for a in args)]
    bad = []
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, folder)
            verdict = compare(df, con, sql[n]) if n in sql else f"rows only {df.count()}"
        except Exception as exc:  # noqa: BLE001 - a report, not a handler
            verdict = "ERROR " + str(exc)[:700]
        ok = verdict.startswith("ok") or verdict.startswith("rows only")
        if not ok:
            bad.append(n)
        print(f"{'PASS' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {verdict}", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} passed; failed: {bad}")


if __name__ == "__main__":
    main()
