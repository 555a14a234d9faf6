"""A query beside its SQL: rows, names and values."""

import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) > 2**53 else str(v)
    if isinstance(v, datetime.datetime | datetime.date):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def loose(x):
    try:
        return f"{float(x):.9g}"
    except ValueError:
        return x


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(loose(plain(r[i])) for i in order) for r in data)


def compare(con, df, sql):
    """What differs, or nothing."""
    rel = con.sql(sql)
    c1, r1 = rows(df.columns, df.collect())
    c2, r2 = rows(rel.columns, rel.fetchall())
    if c1 != c2:
        return f"columns {c1} and {c2}"
    if r1 != r2:
        a, b = set(r1), set(r2)
        return f"{len(r1)} and {len(r2)} rows; only Spark: {sorted(a - b)[:3]}; only SQL: {sorted(b - a)[:3]}"
    return "" if r1 else "no rows"
