"""Runs registered queries and their SQL side by side.

    python tests/oracle.py [name ...]      # all queries without arguments
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.9g}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    return "NULL" if value is None else str(value)


def spark_rows(df):
    names = sorted(df.columns)
    rows = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    return names, rows


def oracle_rows(con, sql: str):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    return names, sorted(tuple(_plain(r[i]) for i in order) for r in cursor.fetchall())


def difference(df, con, sql: str) -> str | None:
    """None when both agree, otherwise what differs first."""
    names, got = spark_rows(df)
    expected_names, expected = oracle_rows(con, sql)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}; extra {sorted(set(got) - set(expected))[:2]}, missing {sorted(set(expected) - set(got))[:2]}"
    for a, b in zip(got, expected):
        if a != b:
            return f"{a} != {b}"
    return None


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from evenkeel.session import session

    spark = session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                status = "ok" if problem is None else f"MISMATCH {problem}"
            else:
                problem, status = None, f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            problem = status = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:28} {time.time() - start:6.2f}s  {status}", flush=True)
    print(f"{failed} failed of {len(names or queries)}")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
