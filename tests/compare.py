"""Run queries next to their SQL checks: python -m tests.compare [folder] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(v)) for v in row)


def spark_rows(frame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    return columns, sorted((tuple(r) for r in frame.select(*columns).collect()), key=_key)


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=_key)


def difference(spark, con, folder: str, name: str) -> str | None:
    columns, rows = spark_rows(contract.queries()[name](spark, folder))
    expected_columns, expected = sql_rows(con, contract.oracle_sql()[name])
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    for got, want in zip(rows, expected):
        if got != want or [type(v) for v in got] != [type(v) for v in want]:
            return f"{got} != {want}"
    return None


if __name__ == "__main__":
    from tallyline.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = local_session(8), database(folder)
    failed = 0
    for name in args or contract.queries():
        start = time.time()
        try:
            problem = difference(spark, con, folder, name)
        except Exception as e:  # report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
