"""Compare registered queries with their SQL oracles: ``python tests/oracle_check.py [dir] [names…]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def ordered(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    flat = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(flat, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """'' when the query and its SQL agree in names, number and values of rows."""
    frame = query(spark, sf_dir)
    got = ordered(frame.columns, [tuple(r) for r in frame.collect()])
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    want = ordered(names, answer.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    if not got:
        return "no rows"
    for g, w in zip(got, want):
        if g != w or [type(a) for a in g] != [type(b) for b in w]:
            return f"{g} != {w}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from millrace.session import local_session

    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            problem = compare(spark, con, query, oracles[name], sf_dir) if name in oracles else "no oracle"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.1f}s {problem}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:]))
