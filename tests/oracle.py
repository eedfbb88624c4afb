"""Run registered queries against their SQL and compare whole results.

    python -m tests.oracle [--sf 0.01] [prefix ...]
"""
from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.10g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty text when equal, otherwise what differs."""
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols, want = canonical([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 20000 else []
        return f"rows {len(got)} != {len(want)} e.g. {extra} / {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return ""


def main() -> int:
    from framelens.session import local_session
    from framelens.workload import ORACLES, QUERIES
    args = sys.argv[1:]
    sf = args.pop(args.index("--sf") + 1) if "--sf" in args else "0.01"
    wanted = [a for a in args if not a.startswith("--")]
    folder = f"/root/testdata/sf{sf}"
    spark, con, bad = local_session(), connect(folder), 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in ORACLES:
                diff = compare(df, con, ORACLES[name])
                n = ""
            else:
                diff, n = "", f"{df.count()} rows, no SQL"
        except Exception as exc:  # report and go on
            diff, n = f"{type(exc).__name__}: {str(exc)[:900]}", ""
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - start:.1f}s {n} {diff}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
