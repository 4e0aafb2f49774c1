"""Runs registered queries against their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def sort_key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=sort_key)


def compare(spark, con, folder, query, sql):
    """``None`` when both sides agree, else a description of the first difference."""
    df = query(spark, folder)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if [type(a) for a in g] != [type(b) for b in w] or g != w:
            return f"{got_names}: {g} != {w}"
    return None


def main():
    import __spark_entry__ as entry
    from veritab.session import build_session

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            if name in entry.oracle_sql():
                verdict = compare(spark, con, folder, query, entry.oracle_sql()[name]) or "ok"
            else:
                verdict = f"rows only: {query(spark, folder).count()}"
        except Exception as error:
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"## {name}: {verdict} [{time.time() - started:.1f}s]", flush=True)


if __name__ == "__main__":
    main()
