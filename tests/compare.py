"""Compare registered queries with their reference SQL: ``python -m tests.compare [sf] [pattern]``."""

from __future__ import annotations

import math
import re
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(value):
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if hasattr(value, "quantize"):
        return f"{float(value):.9g}"
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, fn, sql):
    """None if equal, else what differs."""
    start = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    compare.seconds = time.time() - start
    if sql is None:
        return None, len(got)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got)
    a, b = canonical(df.columns, got), canonical(columns, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(got)
    for x, y in zip(a, b):
        if x != y:
            return f"first difference {x} != {y} (spark, sql)", len(got)
    kinds = {}
    for d in cursor.description:
        kinds[d[0]] = str(d[1])
    odd = [f"{c}:{k}" for c, k in kinds.items() if k in ("HUGEINT",) or k.startswith("DECIMAL")]
    return (f"sql types {odd}" if odd else None), len(got)


def main():
    from __spark_entry__ import oracle_sql, queries
    from wayfind.config import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pattern = sys.argv[2] if len(sys.argv) > 2 else "."
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if not re.search(pattern, name):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        mark = "ok " if problem is None else "BAD"
        bad += problem is not None
        print(f"{mark} {name} rows={n} {time.time() - start:.2f}s (spark {compare.seconds:.2f}s){'' if name in sqls else ' (rows only)'} {problem or ''}", flush=True)
    print(f"bad={bad}")


if __name__ == "__main__":
    main()
