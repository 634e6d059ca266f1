"""Compare registered queries with their SQL: names, types, row counts and values.

    python tests/compare.py [sf_dir] [name prefix …]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
             "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def duck(sf: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0 if value else 0.0)
    return repr(value)


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when Spark rows and SQL rows agree, else a short account of the difference."""
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if rows else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    wanted = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    for name, kind in df.dtypes:
        if SAME_TYPE.get(kind) != types[name].upper():
            return f"type of {name}: {kind} against {types[name]}"
    mine, theirs = rows_of(rows, df.columns), rows_of(wanted, names)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            n = sum(x != y for x, y in zip(mine, theirs))
            return f"{n} rows differ, first {sorted(df.columns)}: {str(a)[:400]} against {str(b)[:400]}"
    return None


def main() -> int:
    from chartspark.plans import QUERIES, SQL
    from chartspark.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    failed = 0
    for name, query in QUERIES.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.perf_counter()
        try:
            df = query(spark, sf)
            problem = difference(df, con, SQL.get(name))
            n = ""
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
            if "-v" in args:
                traceback.print_exc()
        took = time.perf_counter() - start
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {took:.2f}s {'' if name in SQL else '(rows only)'} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
