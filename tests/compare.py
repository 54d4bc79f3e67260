"""Rows of a query and of its SQL on the same files, in a comparable form."""

import math
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "isoformat"):
        return str(value).replace("+00:00", "")
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def duck_rows(text, sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    found = con.execute(text)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(plain(row[i]) for i in order)) for row in found.fetchall())
