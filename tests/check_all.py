"""Runs registered queries on Spark against their SQL: `python -m tests.check_all [name-prefix,...] [sf_dir]`."""

from __future__ import annotations

import sys
import time

from tests.oracle import compare, connect
from turnloom.plans.registry import all_queries, all_sql
from turnloom.session import local_session


def main() -> int:
    wanted = sys.argv[1].split(",") if len(sys.argv) > 1 and sys.argv[1] else [""]
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark = local_session("turnloom-check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf), all_sql(), 0
    for name, fn in all_queries().items():
        if not any(name.startswith(w) for w in wanted):
            continue
        started = time.perf_counter()
        try:
            difference = compare(fn(spark, sf), con, sql[name])
        except Exception as error:  # a failing query is a finding like any other
            difference = f"{type(error).__name__}: {str(error)[:500]}"
        bad += difference is not None
        print(f"{'OK ' if difference is None else 'BAD'} {name} {time.perf_counter() - started:.1f}s {difference or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
