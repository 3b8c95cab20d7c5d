"""Comparing a query with its DuckDB SQL: columns, types and rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "array<double>": "DOUBLE[]", "array<boolean>": "BOOLEAN[]", "array<string>": "VARCHAR[]"}


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}") + 0.0
    return [plain(x) for x in v] if isinstance(v, list) else v


def same(df, con, sql):
    rel = con.execute(sql)
    names, types, rows = [c[0] for c in rel.description], [str(c[1]) for c in rel.description], rel.fetchall()
    got = dict(df.dtypes)
    assert sorted(got) == sorted(names)
    assert {n: TYPES[got[n]] for n in names} == dict(zip(names, types))
    mine = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    assert mine == sorted(repr([plain(x) for x in r]) for r in rows)
