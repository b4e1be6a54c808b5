"""Run a query in Spark and its oracle in DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """One form for values that the engines return in different classes."""
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, function, sql: str, sf_dir: str) -> tuple[bool, str]:
    """Whether the two agree, and a line that says how or where not."""
    start = time.time()
    frame = function(spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    took = time.time() - start
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return False, f"{name}: columns {sorted(frame.columns)} against {sorted(names)}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return False, (
            f"{name}: {len(got)} rows against {len(want)}\n  spark  {only_got}\n"
            f"  duckdb {only_want}"
        )
    return True, f"{name}: {len(got)} rows equal, {took:.1f}s"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from broadsheet.queries import ORACLES, QUERIES
    from broadsheet.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:] or list(QUERIES)
    session, connection = local_session(8), connect(folder)
    failed = 0
    for key in wanted:
        try:
            if key in ORACLES:
                same, line = compare(session, connection, key, QUERIES[key], ORACLES[key], folder)
            else:
                n = QUERIES[key](session, folder).count()
                same, line = True, f"{key}: {n} rows, no oracle"
        except Exception as problem:
            same, line = False, f"{key}: {type(problem).__name__} {str(problem)[:600]}"
        failed += not same
        print("ok  " if same else "FAIL", line[:1800], flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} fine")
