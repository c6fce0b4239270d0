"""Runs a query and its SQL side by side; used by tests."""

import math
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for x in os.listdir(sf_dir):
        con.execute(f"create view {x.split('.')[0]} as select * from '{sf_dir}/{x}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql, sf_dir):
    """None if both give the same columns and rows, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = tables(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        odd = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return f"{len(got)} and {len(want)} rows; {odd}"
    return None
