"""Run registered queries and their SQL side by side: python tests/oracle_check.py [sf] [name ...]."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime) and value.tzinfo:
        return value.replace(tzinfo=None)
    return value


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) if not isinstance(v, (int, float)) or isinstance(v, bool) else (True, "n", float(v)) for v in r))


def compare(spark_df, con, sql: str) -> str:
    """Empty if both sides agree, else what differs."""
    mine_cols, mine = ordered(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    theirs_cols, theirs = ordered([d[0] for d in result.description], result.fetchall())
    if mine_cols != theirs_cols:
        return f"columns {sorted(set(mine_cols) ^ set(theirs_cols))}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    if not mine:
        return "no rows"
    wrong, first, kinds = 0, "", set()
    for a, b in zip(mine, theirs):
        for name, x, y in zip(mine_cols, a, b):
            if type(x) is not type(y) and x is not None and y is not None:
                kinds.add(f"{name}:{type(x).__name__}/{type(y).__name__}")
            if x != y:
                wrong += 1
                first = first or f"{name}: {x!r} != {y!r} in {a[:6]} / {b[:6]}"
    if kinds:
        return f"types {sorted(kinds)} wrong={wrong}"
    return f"{wrong} values, {first}" if wrong else ""


def main(argv) -> int:
    import __spark_entry__ as entry

    from tidepanel.session import panel_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv[1:])]
    spark = panel_session("oracle-check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = "" if df.count() else "no rows"
                name += " (rows only)"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
