"""Tables by chunk are dealt out by their number of rows: a task's memory does not follow the input."""

from __future__ import annotations

import math

import pytest

from cuespark.operators import ledger
from cuespark.plans.production import invalidate_from
from cuespark.plans.streams import ledger_stream

ROWS = [(None if n % 97 == 0 else n // 4, n % 4, float(1 + n * 7 % 50)) for n in range(4000)] + [(5, 1, 50.0), (5, 1, 3.0)]


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "TASK_ROWS", 100)
    spark.createDataFrame(ROWS, "l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def planned():
    most = {}
    for video, chunk, quantity in ROWS:
        most[video, chunk] = max(most.get((video, chunk), 0), math.ceil(quantity / 12.5))
    return most


def parts(df):
    """Rows of each task that has any, as they are after adaptive execution."""
    return [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


def test_ledger_stream(spark, folder, monkeypatch):
    seen, matrix = [], ledger.status_matrix
    monkeypatch.setattr(ledger, "status_matrix", lambda done, chunks: seen.append(done) or matrix(done, chunks))
    got = {r.video_id: (r.chunks, r.chunks_done) for r in ledger_stream(spark, folder).collect()}
    whole = {}
    for (video, _), n in planned().items():
        whole.setdefault(video, []).append(n)
    # a null video matches no flags, so none of its chunks is done
    assert got == {v: (len(ns), 0 if v is None else ns.count(4)) for v, ns in whole.items()}
    sizes = parts(seen[0])
    assert sum(sizes) == sum(planned().values()) and len(sizes) > 40 and max(sizes) < 500


def test_invalidate_from(spark, folder, monkeypatch):
    seen, cut = [], ledger.invalidate_from
    monkeypatch.setattr(ledger, "invalidate_from", lambda book, orders: seen.append(book) or cut(book, orders))
    got = [(r.video_id, r.chunk_index, r.stage) for r in invalidate_from(spark, folder).collect()]
    want = set()
    for (video, chunk), n in planned().items():
        first = 2 if video is not None and video % 5 == 0 and chunk <= 2 else 3 if video is not None and video % 5 == 1 else 5
        want |= {(video, chunk, ledger.STAGES[i - 1]) for i in range(1, n + 1) if i < first}
    assert len(got) == len(set(got)) and set(got) == want
    sizes = parts(seen[0])
    assert sum(sizes) == sum(planned().values()) and len(sizes) > 30 and max(sizes) < 500
