"""Holding a Spark result against SQL over the same files."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 6)
    return value


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    result = con.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, expected = rows_of_sql(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    got = sorted((tuple(_plain(v) for v in r) for r in df.collect()), key=repr)
    want = sorted((tuple(_plain(r[i]) for i in order) for r in expected), key=repr)
    assert got == want
