"""Compares registered queries with their SQL: python tests/compare.py [sf_dir] NAME..."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    if isinstance(v, dict):
        return tuple((k, normal(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, normal(x)) for k, x in v.asDict().items())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in rows)


def sql_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.execute(sql)
    return rows_of([c[0] for c in got.description], got.fetchall())


def main() -> int:
    import __spark_entry__ as entry
    from tests.session import session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, bad = session(), 0
    for name in args or list(entry.queries()):
        began = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            columns, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:
            bad += 1
            print(f"{name}: fails: {str(e)[:600]}", flush=True)
            continue
        took = time.time() - began
        if name not in entry.oracle_sql():
            print(f"{name}: {sum(rows.values())} rows, no SQL, {took:.1f} s", flush=True)
            continue
        try:
            want_columns, want = sql_rows(sf_dir, entry.oracle_sql()[name])
        except Exception as e:
            bad += 1
            print(f"{name}: its SQL fails: {e}", flush=True)
            continue
        same = columns == want_columns and rows == want
        bad += not same
        print(f"{name}: {'ok' if same else 'DIFFERS'} {sum(rows.values())} rows, {took:.1f} s", flush=True)
        if not same:
            print("  ", columns, want_columns, sum(want.values()), "\n   only Spark:", list((rows - want).items())[:3], "\n   only SQL:", list((want - rows).items())[:3])
    return bad


if __name__ == "__main__":
    sys.exit(main())
