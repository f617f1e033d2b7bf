"""Runs registered queries next to their DuckDB statements: ``python tools/check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cuespark.plans.catalog import ORACLES, QUERIES  # noqa: E402
from cuespark.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canon(v):
    if v is None:
        return "<null>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return True, f"{len(got)} rows (no SQL)"
    res = con.execute(ORACLES[name])
    cols = [c[0] for c in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        types = dict(zip(cols, [str(c[1]) for c in con.execute(ORACLES[name]).description]))
        odd = [c for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t or "[]" in t or "STRUCT" in t]
        return True, f"{len(a)} rows" + (f" TYPES {odd}" if odd else "") + (" EMPTY" if not a else "")
    left, right = set(a), set(b)
    return False, f"{len(a)} vs {len(b)} rows; spark-only {sorted(left - right)[:3]} duck-only {sorted(right - left)[:3]}"


def main():
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = args[1:] or list(QUERIES)
    spark = build_session("check", "local[8]", 8)
    con = connect(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {time.time() - t0:6.2f}s  {note[:1600]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
