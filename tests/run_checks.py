"""Compare queries with their SQL: python tests/run_checks.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, "nan") if isinstance(v, float) and math.isnan(v) else (2, repr(float(v)))
    return (3, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_key(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str:
    """Empty if equal, else what differs."""
    got_cols, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {set(got_cols) ^ set(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(c, x[1], y[1]) for c, x, y in zip(got_cols, g, w) if x != y]
        return f"{len(bad)} of {len(got)} rows differ, first: {cells[:4]} in {[x[1] for x in g][:6]}"
    return ""


def session():
    from pyspark.sql import SparkSession

    if os.environ.get("PLAIN_SESSION"):
        # Results must not depend on settings: default partitions, another time zone.
        plain = SparkSession.builder.master("local[8]").config("spark.sql.session.timeZone", "America/New_York")
        spark = plain.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        return spark
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry
    from kinecohort.sources.shared import clear

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].replace(".", "").isdigit() else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                verdict = compare(df, con, oracles[name]) or "ok"
            else:
                verdict = f"ok, {len(df.collect())} rows (no SQL)"
        except Exception as e:
            verdict = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += not verdict.startswith("ok")
        print(f"{name:32s} {time.time() - t:6.2f}s  {verdict}", flush=True)
    print("failed:", failed)
    clear(spark)
