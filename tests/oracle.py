"""A query's rows against its SQL's in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(d):
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for t in TABLES:
        path = f"{d}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def same(spark, d, query, sql):
    df = query(spark, d)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    out = duck(d).sql(sql)
    assert sorted(df.columns) == sorted(out.columns)
    assert got == rows_of(out.columns, out.fetchall())
