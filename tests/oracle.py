"""Rows of a query against those of its SQL in DuckDB, columns by name, in any order."""

import datetime
import glob
import math
import os

import duckdb


def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = glob.glob(f"{p}/*") if os.path.isdir(p) else [p]
        c.sql(f"create view {os.path.basename(p).removesuffix('.parquet')} as select * from read_parquet({files})")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


def assert_same(df, sql, sf_dir):
    c = duck(sf_dir)
    c.sql(f"create temp table answer as {sql}")
    names = [r[0] for r in c.sql("describe answer").fetchall()]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    want = sorted((tuple(map(plain, r)) for r in c.sql(f"select {', '.join(chr(34) + n + chr(34) for n in cols)} from answer").fetchall()), key=repr)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in cols]).collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
