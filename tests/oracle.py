"""Runs SQL over the driver's tables in DuckDB and compares rows without regard to order."""

import glob
import os

import duckdb


def rows_of(sql: str, sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{source}'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    return normal(names, out.fetchall())


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(v, 8) if isinstance(v, float) else (v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v)
    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql: str, sf: str) -> None:
    names, want = rows_of(sql, sf)
    got_names, got = normal(df.columns, [tuple(r) for r in df.collect()])
    assert got_names == names
    assert len(got) == len(want)
    assert [g for g, w in zip(got, want) if g != w] == []
