"""Run registered queries next to their SQL twins.

``python tests/compare.py [name ...]`` with ``SF_DIR`` (default sf0.001) prints one line each.
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def kind(value) -> str:
    return type(value).__name__


def sort_key(row):
    return tuple((v is not None, str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)) for v in row)


def compare(df, connection, sql: str) -> str:
    """Empty when both sides agree, else the first difference."""
    names = sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=sort_key)
    result = connection.execute(sql)
    theirs = [c[0] for c in result.description]
    if sorted(theirs) != names:
        return f"columns {names} != {sorted(theirs)}"
    at = [theirs.index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=sort_key)
    if len(got) != len(want):
        extra = sorted(set(map(str, got)) - set(map(str, want)))[:2]
        missing = sorted(set(map(str, want)) - set(map(str, got)))[:2]
        return f"{len(got)} rows != {len(want)} rows; ours {extra}; theirs {missing}"
    for g, w in zip(got, want):
        for name, a, b in zip(names, g, w):
            if kind(a) != kind(b) and a is not None and b is not None:
                return f"type of {name}: {a!r} != {b!r}"
            if a != b and not (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12)):
                return f"{names}: {g} != {w}"
    return "" if got else "no rows"


def main(selected: list[str]) -> int:
    import __spark_entry__ as entry
    from folioscope.session import get_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = get_session(
        "compare",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = open_oracle(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if selected and name not in selected and not any(s.endswith("*") and name.startswith(s[:-1]) for s in selected):
            continue
        started = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracles:
                problem = compare(df, connection, oracles[name])
            else:
                problem = "" if df.count() else "no rows"
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.1f}s {'' if name in oracles else '(rows only)'} {problem}", flush=True)
    print(f"{bad} failed", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
