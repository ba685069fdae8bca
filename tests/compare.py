"""Run registered queries against their SQL in DuckDB and compare rows by value."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir) -> str:
    """Empty text when both sides agree, otherwise what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return ""
    cur = con.execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows != {len(theirs[1])}"
    off = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(off)} rows differ, first {off[0]}" if off else ""


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from tests.conftest import make_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = make_session()
    con = database(sf)
    sqls = e.oracle_sql()
    for n, q in e.queries().items():
        if only and n not in only:
            continue
        t = time.time()
        try:
            out = compare(spark, con, n, q, sqls.get(n), sf)
        except Exception as ex:  # report and go on with the next query
            out = f"ERROR {type(ex).__name__}: {str(ex)[:1500]}"
        print(f"{'ok  ' if not out else 'FAIL'} {n} {time.time() - t:.1f}s {'' if n in sqls else '(rows)'} {out}", flush=True)
