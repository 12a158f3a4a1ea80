"""Run a registered query on Spark and its SQL on DuckDB and compare the rows.

``python -m tests.compare [name ...]`` checks the named queries, or all of them.
"""

from __future__ import annotations

import datetime as dt
import glob
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb


def plain(value: object) -> object:
    """A value in a form that is equal across the two engines and hashable."""
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return round(value, 9)
    return value


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def sql_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    return [names[i] for i in order], rows


def spark_rows(df) -> tuple[list[str], Counter]:
    names = df.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(plain(r[i]) for i in order) for r in df.collect())
    return [names[i] for i in order], rows


def difference(ours: tuple[list[str], Counter], theirs: tuple[list[str], Counter]) -> str | None:
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    if ours[1] != theirs[1]:
        more, less = ours[1] - theirs[1], theirs[1] - ours[1]
        return (f"{sum(ours[1].values())} against {sum(theirs[1].values())} rows; "
                f"only ours {sum(more.values())}: {list(more)[:2]}; "
                f"only SQL {sum(less.values())}: {list(less)[:2]}")
    return None


def main(names: list[str]) -> int:
    from depotflow.catalog import QUERIES
    from depotflow.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    connection = duck(sf_dir)
    failed = []
    for name in names or list(QUERIES):
        query = QUERIES[name]
        start = time.time()
        try:
            ours = spark_rows(query(spark, sf_dir))
            took = time.time() - start
            start = time.time()
            problem = difference(ours, sql_rows(connection, query.sql)) if query.sql else None
            sql_took = time.time() - start
        except Exception as error:  # report and go on with the next query
            problem, took, sql_took = f"{type(error).__name__}: {str(error)[:600]}", 0, 0
            ours = ([], Counter())
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:32} {sum(ours[1].values()):7} rows "
              f"{took:6.1f}s sql {sql_took:5.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
