"""Compare Spark results with DuckDB's, without regard to row order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{float(x):.9g}"
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    result = con.execute(sql)
    want = table([d[0] for d in result.description], result.fetchall())
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]
