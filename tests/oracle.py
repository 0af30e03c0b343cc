"""Runs a registered query and its oracle SQL side by side. Also a script: python -m tests.oracle SF_DIR NAME..."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "quantize"):
        return round(float(v), 6)
    return v


def duck(sf_dir: str, sql: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    r = c.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def compare(spark, sf_dir: str, query, sql: str) -> tuple[int, list]:
    """Rows of the result, and the differences (empty: equal as multisets, columns by name)."""
    df = query(spark, sf_dir)
    cols = df.columns
    names, rows = duck(sf_dir, sql)
    if sorted(cols) != sorted(names):
        return 0, [("columns", sorted(cols), sorted(names))]
    order = sorted(cols)
    got = Counter(tuple(norm(r[cols.index(c)]) for c in order) for r in map(tuple, df.collect()))
    want = Counter(tuple(norm(r[names.index(c)]) for c in order) for r in rows)
    diff = [("spark only", x) for x in list((got - want).elements())[:3]] + [("oracle only", x) for x in list((want - got).elements())[:3]]
    return sum(got.values()), diff


def local_spark():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as e

    spark, qs, sqls = local_spark(), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or qs:
        t = time.time()
        try:
            if name in sqls:
                print(name, *compare(spark, sys.argv[1], qs[name], sqls[name]), f"{time.time() - t:.1f}s", flush=True)
            else:
                df = qs[name](spark, sys.argv[1])
                print(name, "no oracle; rows", df.count(), f"{time.time() - t:.1f}s", flush=True)
                df.show(3, 100)
        except Exception as x:
            print(name, "FAILED", str(x)[:1500], flush=True)
