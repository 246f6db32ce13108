"""Runs registered queries next to their SQL in DuckDB and compares the rows.

    python -m tests.compare [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import importlib
import math
import time
import traceback

import duckdb

from ratiocert.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def key_of(row):
    return tuple((v is None, str(type(v).__name__) if v is None else "", f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)


def compare(spark, con, fn, sql: str, sf: str) -> tuple[str, int, float]:
    """'exact', 'close' (floats within 1e-6 relative) or a description of the difference."""
    start = time.time()
    df = fn(spark, sf)
    names = sorted(df.columns)
    mine = [tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    took = time.time() - start
    rel = con.execute(sql)
    theirs_names = [d[0] for d in rel.description]
    raw = rel.fetchall()
    if sorted(theirs_names) != names:
        return f"columns differ: {names} / {sorted(theirs_names)}", len(mine), took
    order = [theirs_names.index(n) for n in names]
    theirs = [tuple(plain(r[i]) for i in order) for r in raw]
    if len(mine) != len(theirs):
        return f"row counts differ: {len(mine)} / {len(theirs)}", len(mine), took
    mine.sort(key=key_of)
    theirs.sort(key=key_of)
    state = "exact"
    for a, b in zip(mine, theirs):
        if a == b:
            if [type(x) for x in a] != [type(x) for x in b]:
                state = f"types differ: {a} / {b}"
            continue
        for x, y in zip(a, b):
            if x == y:
                continue
            if isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-6 * max(1.0, abs(x), abs(y)):
                state = "close"
                continue
            return f"rows differ: {str(a)[:400]} / {str(b)[:400]}", len(mine), took
    return state, len(mine), took


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("keys", nargs="*")
    args.add_argument("--sf", default="0.01")
    args.add_argument("--module")
    opts = args.parse_args()
    from registry import base

    if opts.module:
        for m in opts.module.split(","):
            importlib.import_module(f"registry.{m}")
    else:
        importlib.import_module("registry")
    sf = f"/root/testdata/sf{opts.sf}"
    spark = local_session()
    con = connection(sf)
    bad = 0
    for key in opts.keys or list(base.QUERIES):
        try:
            if key in base.SQL:
                state, n, took = compare(spark, con, base.QUERIES[key], base.SQL[key], sf)
            else:
                t = time.time()
                n = base.QUERIES[key](spark, sf).count()
                state, took = "rows only", time.time() - t
        except Exception:
            state, n, took = "ERROR " + traceback.format_exc()[-1500:], -1, 0.0
        ok = state in ("exact", "close", "rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {key:28s} {took:6.2f}s {n:8d} rows  {state}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
