"""Run a query and its SQL side by side and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(df, sql: str, con) -> str | None:
    """None if equal, else what differs."""
    ours = normalise(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = normalise([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        only = [r for r in ours[1] if r not in set(theirs[1])][:2] if len(ours[1]) < 20000 else []
        return f"rows {len(ours[1])} != {len(theirs[1])} {only}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b and repr(a) != repr(b):
            return f"first difference\n  ours   {repr(a)[:600]}\n  theirs {repr(b)[:600]}"
    return None
