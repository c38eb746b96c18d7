"""Compare a registered query with its SQL twin in DuckDB, without regard to row order."""

import os

import duckdb


def rows_of(table):
    names = sorted(table.column_names)
    columns = [table[n].to_pylist() for n in names]
    plain = lambda v: repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)
    return names, sorted(tuple(map(plain, r)) for r in zip(*columns, strict=True))


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def assert_same(df, sql, sf_dir):
    assert rows_of(df.toArrow()) == rows_of(connect(sf_dir).sql(sql).to_arrow_table())
