"""Run registered queries beside their SQL twins and compare whole results.

    python tests/oracle_check.py <data dir> [name part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _cell(v.item())
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(df, con, sql: str) -> str:
    """Empty when both results are equal, otherwise what differs."""
    names = sorted(df.columns)
    ours = sorted((tuple(_cell(r[n]) for n in names) for r in df.select(*names).collect()), key=_key)
    rel = con.sql(sql)
    theirs_names = sorted(rel.columns)
    if names != theirs_names:
        return f"columns {names} != {theirs_names}"
    index = [rel.columns.index(n) for n in names]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    for n, i in zip(names, index):
        have, want = dict(df.dtypes)[n], str(rel.types[i])
        if kinds.get(have, have) != want:
            return f"type of {n}: {have} != {want}"
    theirs = sorted((tuple(_cell(r[i]) for i in index) for r in rel.fetchall()), key=_key)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}; e.g. {ours[:1]} {theirs[:1]}"
    if not ours:
        return "no rows"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ ({names}): {str(bad[0])[:700]}" if bad else ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from quire.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    parts = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    all_queries, sqls = queries(), oracle_sql()
    failures = 0
    for name, fn in all_queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        mid = start
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                con.sql(sqls[name]).fetchall()
            mid = time.time()
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                problem = "" if df.count() > 0 else "no rows"
        except Exception as e:  # report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        failures += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} sql {mid - start:5.1f}s spark {time.time() - mid:5.1f}s {'' if name in sqls else '(rows only) '}{problem}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
