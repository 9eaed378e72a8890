"""Compare a Spark result with its SQL, order aside."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    cur = con.execute(sql)
    want_names, want = canonical([d[0] for d in cur.description], cur.fetchall())
    got_names, got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if want_names != got_names:
        return f"columns {got_names} != {want_names}"
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}; got {got[:1]} want {want[:1]}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g if x is not None] != [type(x) for x in w if x is not None]:
            return f"got {g} want {w}"
    return None
