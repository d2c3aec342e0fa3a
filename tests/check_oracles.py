"""Run queries beside their SQL: python tests/check_oracles.py FOLDER [name ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbscore.catalog import ORACLES, QUERIES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """An in-memory database with a view per table."""
    connection = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else 0.0 if value == 0 else value
    return value


def compare(found: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    wanted = connection.execute(sql)
    names = [d[0] for d in wanted.description]
    if sorted(names) != sorted(found.columns):
        return f"columns {sorted(found.columns)} instead of {sorted(names)}"
    rows = Counter(tuple(_plain(v) for v in row) for row in wanted.fetchall())
    mine = Counter(tuple(_plain(v) for v in row) for row in found.select(names).collect())
    if rows == mine:
        return None
    return f"{sum(mine.values())} rows instead of {sum(rows.values())}; only found: {list((mine - rows).items())[:3]}; only wanted: {list((rows - mine).items())[:3]}"


if __name__ == "__main__":
    from plumbscore.session import build_session

    session = build_session(cores=8)
    session.sparkContext.setLogLevel("ERROR")
    database = connect(sys.argv[1])
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        begun = time.time()
        try:
            result = QUERIES[name](session, sys.argv[1])
            if name in ORACLES:
                problem = compare(result, database, ORACLES[name])
            else:
                problem = None if result.count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {time.time() - begun:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
