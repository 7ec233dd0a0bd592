"""Run named queries in Spark and DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(spark, con, name: str, fn, sql: str, sf_dir: str) -> str | None:
    """Null when both sides agree in columns, types of value and rows."""
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if mine != theirs:
        left, right = set(map(repr, mine)), set(map(repr, theirs))
        return (f"{len(mine)} rows against {len(theirs)}; only Spark: {sorted(left - right)[:2]}; "
                f"only SQL: {sorted(right - left)[:2]}")
    return None if mine else "no rows"


def main(sf_dir: str, only: list[str]) -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from footmark.session import local_session
    spark = local_session()
    con = connect(sf_dir)
    sql, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            if name in sql:
                found = difference(spark, con, name, fn, sql[name], sf_dir)
            else:
                found = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:700]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - t:.1f}s {found or ''}", flush=True)
    print("without SQL:", [n for n in entry.queries() if n not in sql], "SQL only:", [n for n in sql if n not in entry.queries()])
    print("different:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
