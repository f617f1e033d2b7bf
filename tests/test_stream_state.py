"""Keyed stream jobs that let go of final rows: the same results as over the whole table, in bounded state."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuespark.sources import logs
from cuespark.streaming import jobs
from cuespark.streaming.runner import drain_keyed, late_of, open_rows


def feed(spark, tmp_path, rows, schema, parts):
    """The rows as one file to a micro-batch, read in the order they were written."""
    size = -(-len(rows) // parts)
    df = spark.createDataFrame(rows, schema)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return df, stream, str(tmp_path / "work")


def jittered(rng, rows, at, by):
    """Rows in the order they arrive: by a time of at most ``by`` after their own."""
    return sorted(rows, key=lambda r: r[at] + rng.uniform(0, by))


def same(got, want):
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("parts", [1, 5])
def test_sessions(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = jittered(rng, [(rng.choice([None, 1, 1, 2, 3]), rng.randint(0, 4000) * 5, 1.0) for _ in range(600)], 1, 40)
    df, stream, work = feed(spark, tmp_path, rows, "user_id long, s long, value double", parts)
    timed = lambda d: d.selectExpr("user_id", "timestamp_seconds(s) AS ts", "value")
    got = drain_keyed(timed(stream), "s", "user_id", lambda e: jobs.activity_sessions(e, 60.0), work, jobs.session_lifetime(40.0, 60.0))
    same(got, jobs.activity_sessions(timed(df), 60.0))
    if parts > 1:
        assert open_rows(spark, work, timed(stream).schema).count() < 60
        assert late_of(spark, work, timed(stream).schema).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_silences(spark, tmp_path, parts):
    rng = random.Random(10 + parts)
    line = lambda n: rng.choice([f"silence_start: {n}", f"silence_end: {n} | silence_duration: 1", "frame=1"])
    rows = jittered(rng, [(rng.choice([None, 1, 2]), n, line(n)) for n in range(500)], 1, 15)
    df, stream, work = feed(spark, tmp_path, rows, "source long, line_no long, line string", parts)
    got = drain_keyed(stream, "l", "source", logs.silences_from_log, work, jobs.silence_lifetime(15))
    same(got, logs.silences_from_log(df))
    if parts > 1:
        assert open_rows(spark, work, df.schema).count() < 120


@pytest.mark.parametrize("parts", [1, 5])
def test_requests(spark, tmp_path, parts):
    """Requests that settle, time out, show a banner, never show anything, or speak again long after their end."""
    rng = random.Random(20 + parts)
    rows = []
    for request in range(40):
        begun, shown = request * 25.0, rng.choice([0.0, 8.0, 30.0, 70.0, 500.0])
        times = sorted({float(rng.randint(0, 60 if request % 7 == 0 else 200)) for _ in range(rng.randint(1, 25))} | {0.0})
        times += [400.0] if request % 5 == 0 else []
        for t in times:
            rows.append((request, len(rows), begun + t, rng.choice(["", "a", "a", "b"]), int(t >= shown), rng.random() < 0.1, rng.random() < 0.03))
    rows = jittered(rng, rows, 2, 20)
    df, stream, work = feed(spark, tmp_path, rows, "request_id long, ord long, t_sec double, text string, count int, generating boolean, banner boolean", parts)
    now = max(r[2] for r in rows)
    settle = lambda s: jobs.settle(s, 10.0, 150.0, now)
    got = drain_keyed(stream, "r", "request_id", settle, work, jobs.settle_lifetime(20.0, 150.0, 1000.0))
    same(got, settle(df))
    if parts > 1:
        assert open_rows(spark, work, df.schema).select("request_id").distinct().count() < 25


@pytest.mark.parametrize("parts", [1, 5])
def test_jobs(spark, tmp_path, parts):
    """Jobs that end well before the stream does are let go; those that run, however old, stay."""
    rng = random.Random(30 + parts)
    kinds = ["start", "done", "error", "cancel", "clear", "step", "step"]
    rows = [(j, 30.0 * j + rng.randint(0, 60), j * 20 + i, rng.choice(kinds), i) for j in range(30) for i in range(12)]
    rows = jittered(rng, rows, 1, 10)
    df, stream, work = feed(spark, tmp_path, rows, "job_id long, t_sec double, ord long, event string, step int", parts)
    got = drain_keyed(stream, "j", "job_id", jobs.job_states, work, jobs.job_lifetime(10.0, 100.0))
    same(got, jobs.job_states(df))
    if parts > 1:
        held = {r.job_id for r in open_rows(spark, work, df.schema).select("job_id").distinct().collect()}
        running = {r.job_id for r in jobs.job_states(df).filter("state = 'running'").collect()}
        assert running <= held and len(held) < 30


def test_late_rows_are_set_aside(spark, tmp_path):
    """A row behind the watermark changes nothing and is kept apart; one within the delay counts; a null time is never late."""
    rows = [(1, 0, 1.0), (1, 10_000, 1.0), (1, 5, 7.0), (1, 9_950, 2.0), (1, 9_960, 2.0), (2, None, 3.0)]
    df, stream, work = feed(spark, tmp_path, rows, "user_id long, s long, value double", 3)
    timed = stream.selectExpr("user_id", "timestamp_seconds(s) AS ts", "value")
    got = drain_keyed(timed, "s", "user_id", lambda e: jobs.activity_sessions(e, 60.0), work, jobs.session_lifetime(100.0, 60.0))
    found = sorted((r.user_id, r.events, r.value) for r in got.filter("user_id = 1").collect())
    assert found == [(1, 1, 1.0), (1, 3, 5.0)]
    assert [(r.value, r.batch_id) for r in late_of(spark, work, timed.schema).collect()] == [(7.0, 1)]


def test_cost_of_a_batch_does_not_grow(spark, tmp_path):
    """Twelve batches of the same size: the state after the last is no larger than after the fourth, and old ones are gone."""
    rows = [(i % 5, i * 10, 1.0) for i in range(1200)]
    df, stream, work = feed(spark, tmp_path, rows, "user_id long, s long, value double", 12)
    timed = lambda d: d.selectExpr("user_id", "timestamp_seconds(s) AS ts", "value")
    got = drain_keyed(timed(stream), "s", "user_id", lambda e: jobs.activity_sessions(e, 40.0), work, jobs.session_lifetime(50.0, 40.0))
    same(got, jobs.activity_sessions(timed(df), 40.0))
    assert open_rows(spark, work, timed(stream).schema).count() <= 12
    states = sorted(p.name for p in (tmp_path / "work" / "rows").iterdir())
    assert states == ["batch_id=10", "batch_id=11"]
