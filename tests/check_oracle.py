"""Run registered queries beside their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as registered  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(r[i] for i in order) for r in rows], key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty when Spark and SQL agree, else what differs."""
    df = registered.queries()[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    found = con.execute(registered.oracle_sql()[name])
    theirs = rows_of([c[0] for c in found.description], found.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows against {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            return f"{a} against {b}"
    return "" if ours[1] else "no rows"


if __name__ == "__main__":
    from vicinal.session import local_session

    spark = local_session("8")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registered.queries())
    con, bad = connect(sf), 0
    for name in names:
        t = time.time()
        try:
            problem = compare(spark, con, name, sf)
        except Exception as e:  # report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    sys.exit(bad > 0)
