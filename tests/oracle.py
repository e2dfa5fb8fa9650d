"""Compare registered queries with their oracle SQL in DuckDB.

    python -m tests.oracle [sf] [name-or-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from parcelgrid.fixtures import TABLES


def open_duckdb(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


def _sort_key(row):
    return tuple((v is None, str(type(v).__name__ != "str"), str(v)) for v in row)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=_sort_key)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, otherwise a short description of the difference."""
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    got_cols = spark_df.columns
    got = rows_of(got_cols, [tuple(r) for r in spark_df.collect()])
    if sorted(want_cols) != sorted(got_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(want) != len(got):
        return f"rows spark={len(got)} oracle={len(want)}\n  spark  {got[:2]}\n  oracle {want[:2]}"
    if want and [type(v).__name__ for v in want[0]] != [type(v).__name__ for v in got[0]]:
        if any(type(a) is not type(b) and a is not None and b is not None for a, b in zip(want[0], got[0])):
            return f"types {sorted(got_cols)} spark={got[0]} oracle={want[0]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        a, b = bad[0]
        return f"{len(bad)}/{len(got)} rows differ {sorted(got_cols)}\n  spark  {a}\n  oracle {b}"
    return None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from parcelgrid.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = open_duckdb(sf_dir)
    sqls, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(fn(spark, sf_dir), con, sqls[name])
            else:
                n = fn(spark, sf_dir).count()
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
