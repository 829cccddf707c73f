"""Order-free comparison of a Spark result with a DuckDB result."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f{round(v, 6) + 0.0}"
    return f"s{v}"


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(cell, r)) for r in df.select(*cols).collect())


def rows_of_sql(con, sql):
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    wide = [c for c, t in zip(rel.columns, rel.types) if "HUGE" in str(t) or "DECIMAL" in str(t)]
    assert not wide, f"columns {wide} would not compare by type"
    listed = ", ".join(f'"{c}"' for c in cols)
    got = con.sql(f"SELECT {listed} FROM ({sql}) q").fetchall()
    return cols, sorted(tuple(map(cell, r)) for r in got)
