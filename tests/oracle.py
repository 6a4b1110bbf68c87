"""Runs a query with Spark and its SQL with DuckDB and compares rows, as multisets."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else float(f"{v:.9g}"))
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs_rows = cur.fetchall()
    cols = spark_df.columns
    if sorted(cols) != sorted(names):
        return f"columns {sorted(cols)} against {sorted(names)}"
    order = sorted(cols)
    ours = Counter(tuple(norm(r[c]) for c in order) for r in spark_df.collect())
    at = [names.index(c) for c in order]
    theirs = Counter(tuple(norm(r[i]) for i in at) for r in theirs_rows)
    if ours == theirs:
        return None
    a, b = ours - theirs, theirs - ours
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; {order}; only ours {sum(a.values())}: {list(a)[:3]}; only theirs {sum(b.values())}: {list(b)[:3]}"
