"""Run registered queries beside their SQL twins: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    theirs = rows_of([d[0] for d in rel.description], rel.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} vs {theirs[0]}"
    if mine[1] != theirs[1]:
        only_mine = [r for r in mine[1] if r not in set(theirs[1])][:3]
        only_theirs = [r for r in theirs[1] if r not in set(mine[1])][:3]
        return f"{len(mine[1])} vs {len(theirs[1])} rows; ours {only_mine} theirs {only_theirs}"
    return None if mine[1] else "both empty"


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_spark

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = make_spark(), connect(sf_dir)
    bad = 0
    sql = oracle_sql()
    for name, fn in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, name, fn, sql[name], sf_dir)
            else:
                problem = None if fn(spark, sf_dir).count() else "empty"
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
