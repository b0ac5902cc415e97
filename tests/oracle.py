"""Side-by-side runs of a Spark query and its SQL in DuckDB."""

import math
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: ("nan" if math.isnan(x) else repr(round(x, 6) + 0.0)) if isinstance(x, float) else str(x)
    return sorted(columns), sorted([tuple(cell(r[i]) for i in order) for r in rows])


def same(df, con, sql):
    ours = bag(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    theirs = bag([d[0] for d in rel.description], rel.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
    return len(ours[1])
