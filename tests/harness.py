"""Run a Spark result and its SQL counterpart and compare them as bags of rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for f in glob.glob(folder + "/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (str(int(v)) if v == int(v) else f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return {k: norm(x) for k, x in v.items()}
    return str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        [tuple(str(norm(r[i])) for i in order) for r in rows]
    )


def compare(df, con, sql: str):
    """None when equal, else a short description of the difference."""
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = bag(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        miss = [r for r in want[1] if r not in set(got[1])][:2]
        return f"rows {len(got[1])} != {len(want[1])}; only spark {extra}; only sql {miss}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"row\n spark {a}\n sql   {b}"
    return None


def one(spark, **values):
    """One-row frame of string columns."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
