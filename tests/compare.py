"""Runs registered queries beside their DuckDB check and reports differences.

    python tests/compare.py [folder] [name prefix ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def kind(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    return type(value).__name__


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return repr([norm(v) for v in value])
    return repr(value)


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(df, con, sql):
    """None when equal, else a message."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    expected = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    got = [tuple(r[c] for c in order) for r in df.collect()]
    want = [tuple(r[names.index(c)] for c in order) for r in expected]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for i, c in enumerate(order):
        kg = {kind(r[i]) for r in got} - {None}
        kw = {kind(r[i]) for r in want} - {None}
        if kg != kw:
            return f"type of {c}: {kg} != {kw}"
    a = sorted(tuple(map(norm, r)) for r in got)
    b = sorted(tuple(map(norm, r)) for r in want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {order}\n   {bad[0][0]}\n   {bad[0][1]}"
    return None if got else "EMPTY (equal)"


def main():
    import __spark_entry__ as entry
    from txnspark.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = build_session("compare", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                message = compare(df, con, oracles[name])
            else:
                rows = df.collect()
                message = None if rows else "EMPTY (no check)"
        except Exception as exc:  # noqa: BLE001
            message = f"{type(exc).__name__}: {str(exc)[:1500]}"
        state = "ok " if message is None else "BAD"
        bad += message is not None
        print(f"{state} {name:38s} {time.time() - t0:6.1f}s {'' if name in oracles else '[rows]'}"
              f" {message or ''}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
