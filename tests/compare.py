"""Comparing a query with its SQL, rows as multisets."""

import glob
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return repr(v)


def connection(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def both(spark, folder, query, sql):
    """(rows of the query, rows of the SQL), columns by name."""
    df = query(spark, folder)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = connection(folder).execute(sql)
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    return got, Counter(tuple(plain(r[cols.index(c)]) for c in names) for r in rel.fetchall())
