"""Run a registered query beside its SQL and compare rows as multisets."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(
        tuple(_norm(r[i]) for i in order) for r in cur.fetchall())


def difference(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    ca, a = rows_of_spark(df)
    cb, b = rows_of_duck(con, sql)
    if ca != cb:
        return f"columns {ca} != {cb}"
    if a == b:
        return None
    only_a, only_b = a - b, b - a
    return (f"rows {sum(a.values())} vs {sum(b.values())}; spark only {list(only_a)[:3]}; "
            f"sql only {list(only_b)[:3]}")
