"""Compare registered queries with their SQL: python tools/check.py [sf] [name ...]."""

from __future__ import annotations

import math
import os
import signal
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quillon.session import local_session  # noqa: E402
from quillon.suite import REGISTRY  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


LIMIT = int(os.environ.get("CHECK_SECONDS", "90"))


def too_long(*_: object) -> None:
    raise TimeoutError(f"over {LIMIT} s")


signal.signal(signal.SIGALRM, too_long)


def plain(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows(columns: list[str], data: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf: str, name: str) -> str:
    entry = REGISTRY[name]
    start = time.time()
    df = entry.job(spark, sf)
    got = df.collect()
    took = time.time() - start
    if entry.sql is None:
        return f"rows {len(got):7d} {took:6.1f}s  (no SQL)"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    start = time.time()
    cur = con.execute(entry.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    verdict = "ok" if a == b else "DIFF"
    line = f"{verdict} {len(a):7d} vs {len(b):7d} {took:6.1f}s sql {sql_took:5.1f}s"
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a = [r for r in a if r not in in_b][:3]
        only_b = [r for r in b if r not in in_a][:3]
        line += f"\n   cols {sorted(names)}\n   spark {only_a}\n   sql   {only_b}"
    return line


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = local_session(8)
    bad = 0
    for name in names:
        try:
            signal.alarm(LIMIT)
            line = compare(spark, f"/root/testdata/sf{sf}", name)
        except Exception:
            signal.alarm(0)
            spark.sparkContext.cancelAllJobs()
            line = "ERROR " + traceback.format_exc(limit=-3)[-1500:]
        signal.alarm(0)
        bad += not line.startswith(("ok", "rows"))
        print(f"{name:34s} {line}", flush=True)
    print("failures:", bad)


main()
