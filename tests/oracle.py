"""Compares queries with their SQL, as the driver does: `python tests/oracle.py [sf dir] [name ...]`."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(shown, key=repr)


def _plain(x):
    if isinstance(x, float):
        return 0.0 if x == 0 else x
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    return x


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def differences(spark, con, sf_dir, query, sql) -> str:
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    want_names, want = rows_of([c[0] for c in rel.description], rel.fetchall())
    if names != want_names:
        return f"columns {names} against {want_names}"
    if got == want:
        return ""
    a, b = set(map(repr, got)), set(map(repr, want))
    return f"{len(got)} rows against {len(want)}; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = connect(sf), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or list(q):
        t = time.time()
        try:
            if name in o:
                bad = differences(spark, con, sf, q[name], o[name])
                print(f"{name}: {'ok' if not bad else 'DIFFERS ' + bad[:900]} ({time.time() - t:.1f} s)", flush=True)
            else:
                print(f"{name}: {q[name](spark, sf).count()} rows, no SQL ({time.time() - t:.1f} s)", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: FAILED {str(e)[:700]}", flush=True)
