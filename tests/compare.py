"""Compare a query's rows with its SQL's in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x) + 0.0:.5f}"
    return str(x)


def differences(spark, con, f, sql, sf_dir):
    df = f(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(map(cell, (r[n] for n in names))) for r in df.collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    order = [rel.columns.index(n) for n in names]
    want = sorted(tuple(cell(r[i]) for i in order) for r in rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    kinds = dict(df.dtypes)
    sql_kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "int": "INTEGER", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    odd = [(n, kinds[n], sql_kinds[n]) for n in names if same.get(kinds[n], sql_kinds[n]) != sql_kinds[n]]
    return f"{len(bad)} of {len(got)} differ: {bad[:2]}" if bad else f"types {odd}" if odd else ""
