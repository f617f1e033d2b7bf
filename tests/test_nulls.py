"""Ordered scans with rows that lack a key or a time: all come out, keyless rows as one key, timeless rows first."""

from __future__ import annotations

import random

import pytest

from cuespark.operators import ranges
from cuespark.operators.scan import SLAB_ROWS_CONF, Axis, Lag, RowNumber, RunLast, RunMax, RunSum, Total, scan


def rows(n):
    rng = random.Random(6)
    return [(rng.choice([None, 1, 2]), None if rng.random() < 0.1 else rng.randint(0, 300) / 10, i, rng.choice([None, 1, 2, 3])) for i in range(n)]


def in_order(data):
    return sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2]))


@pytest.mark.parametrize("limit", ["0", "7"])
def test_scan(spark, limit):
    data = rows(400)
    spark.conf.set(SLAB_ROWS_CONF, limit)
    try:
        df = spark.createDataFrame(data, "k int, t double, i int, v int")
        got = scan(df, Axis.time("k", ("t", "i")), Lag("lag", "v"), RowNumber("n"), RunSum("s", "v"), RunMax("m", "v"), RunLast("l", "v"), Total("all", "v")).collect()
    finally:
        spark.conf.unset(SLAB_ROWS_CONF)
    assert len(got) == len(data)
    seen = {r.i: r for r in got}
    total = {k: sum(r[3] or 0 for r in data if r[0] == k) for k in (None, 1, 2)}
    key, before = "none yet", []
    for k, _, i, v in in_order(data):
        if k != key:
            key, before = k, []
        r = seen[i]
        known = [x for x in [*before, v] if x is not None]
        assert r["lag"] == (before[-1] if before else None) and r.n == len(before) + 1 and r["all"] == total[k]
        assert (r.s or 0) == sum(known) and r.m == (max(known) if known else None) and r.l == (known[-1] if known else None)
        before.append(v)


def test_chains(spark):
    data = [(k, None if t is None else float(t), None if t is None else float(t + 3), i) for i, (k, t) in enumerate(
        [(None, 1), (None, 2), (None, 9), (1, None), (1, 5), (1, 7), (2, None), (None, None)])]
    df = spark.createDataFrame(data, "k int, start_sec double, end_sec double, i int")
    merged = ranges.merge_ranges(df, "k").collect()
    assert sorted((r.k or 0, r.start_sec or 0, r.end_sec or 0) for r in merged) == [(0, 0, 0), (0, 1, 5), (0, 9, 12), (1, 0, 0), (1, 5, 10), (2, 0, 0)]
    runs = ranges.reset_ids(df, Axis.time("k", ("start_sec", "i")), ["start_sec"], lambda cur, prev: cur("start_sec") - prev("start_sec") > 3, "run").collect()
    assert len(runs) == len(data) and {r.i: r.run.i for r in runs} == {7: 7, 0: 7, 1: 7, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6}


def test_rows_are_dealt_once(spark):
    df = spark.range(0, 5000).selectExpr("id % 7 AS k", "CAST(id AS double) AS t", "id % 3 AS v")
    runs = scan(df, Axis.time("k", "t"), RunSum("s", "v"), Lag("p", "v"))
    runs.collect()
    plan = runs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("REPARTITION_BY_COL") <= 2
