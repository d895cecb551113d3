"""Run registered queries next to their SQL and report differences.

    python tests/check_oracles.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract
from roadsky.session import local_session


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def as_sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, name: str, sf_dir: str) -> str:
    """Empty text when the two results are the same rows."""
    df = contract.queries()[name](spark, sf_dir)
    rows = [tuple(row) for row in df.collect()]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return "" if rows else "no rows"
    result = connection.execute(sql)
    columns = [column[0] for column in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    mine, theirs = as_sorted(rows, df.columns), as_sorted(expected, columns)
    if mine == theirs:
        return ""
    mine_set, theirs_set = set(mine), set(theirs)
    only_mine = [row for row in mine if row not in theirs_set][:3]
    only_theirs = [row for row in theirs if row not in mine_set][:3]
    return f"{len(mine)} rows against {len(theirs)}; only Spark {only_mine}; only SQL {only_theirs}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.queries())
    spark = local_session("oracles", "8")
    connection = oracle_connection(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            message = compare(spark, connection, name, sf_dir)
        except Exception as error:
            message = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(message)
        print(f"{'FAIL' if message else 'ok  '} {time.time() - started:6.2f}s {name} {message}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
