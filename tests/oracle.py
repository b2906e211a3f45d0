"""Rows of a Spark query against rows of DuckDB's SQL over the same files."""

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(df, sql, folder):
    con = duckdb.connect()
    for p in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    con.execute(sql)
    names = [x[0] for x in con.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, con.fetchall())
