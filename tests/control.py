"""Times the oracle SQL of the bench's queries in DuckDB, as a single-node control: python -m tests.control SF_DIR."""

from __future__ import annotations

import json
import sys
import time

import duckdb

import __spark_entry__ as entry
import bench
from tests.oracle import TABLES
from tributary.functions.stats import trimmed_mean

if __name__ == "__main__":
    c, sqls, out = duckdb.connect(), entry.oracle_sql(), {}
    c.execute("SET TimeZone='UTC'; SET threads=8")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sys.argv[1]}/{t}.parquet'")
    for name in (n for n in bench.HEADLINE if n in sqls):
        times = []
        for _ in range(4):
            began = time.perf_counter()
            c.execute(sqls[name]).to_arrow_table()
            times.append(time.perf_counter() - began)
            if times[0] > 10:
                break
        out[name] = round(trimmed_mean(times[1:]) if len(times) > 1 else times[0], 3)
        print(name, out[name], file=sys.stderr, flush=True)
    print(json.dumps(out))
