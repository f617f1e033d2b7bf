"""Tracks of clips by sweep line against a sample-by-sample version; lengths of joined tracks; levels of reports."""

from __future__ import annotations

import random

import pytest

from cuespark.operators import fit, mix

CHUNKS = "video_id long, chunk_index long, total_ms long"
CLIPS = "video_id long, chunk_index long, placed_start_ms long, placed_end_ms long, amplitude double"


@pytest.mark.parametrize("rate", [1, 7, 500])
def test_overlay_and_concat(spark, rate):
    rng = random.Random(rate)
    chunks = [(v, c, rng.choice((0, 3, 40, 999, 1500))) for v in range(4) for c in range(6)]
    clips = [(v, c, a, a + rng.randrange(-5, 700), rng.choice((0.1, 0.2, 0.3, -1.5, 7.0))) for v, c, _ in chunks for a in (rng.randrange(-50, 1600) for _ in range(8))]
    clips += [(9, 9, 0, 100, 1.0)]  # of no chunk
    want, at = {}, {}
    for v, c, total in chunks:
        first, at[v] = at.get(v, 0) // rate, at.get(v, 0) + total
        for i in range(at[v] // rate - first):
            want[v, first + i] = sum(a for cv, cc, s, e, a in clips if (cv, cc) == (v, c) and s <= i * rate < e)
    c, k = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(clips, CLIPS)
    samples = mix.overlay(k, c, rate)
    got = {(r.video_id, r.sample_no): r.value for r in mix.concat_chunks(samples, c, rate).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    assert all(got[x] == 0.0 for x in want if abs(want[x]) < 1e-12)  # silence is silence again
    assert mix.length_errors(samples, c, rate).count() == 0
    for v, total in at.items():  # what chunks have beyond whole steps is carried on
        assert sum(1 for x in got if x[0] == v) == total // rate
    short = mix.length_errors(samples.filter("NOT (video_id = 1 AND sample_no = 0)"), c, rate).collect()
    assert {(r.video_id, r.expected - r.found) for r in short} == {(1, 1)}
    assert [tuple(r) for r in mix.length_errors(samples.limit(0).unionByName(spark.createDataFrame([(7, 1, 0, 0.0)], samples.schema)), c.limit(0), rate).collect()] == [(7, 1, 0, 1)]


def test_a_long_clip_is_two_steps(spark):
    chunks = mix.chunk_samples(spark.createDataFrame([(1, 0, 100_000_000)], CHUNKS), 1)
    runs = mix.overlay_runs(spark.createDataFrame([(1, 0, 10, 90_000_000, 2.0), (1, 0, 50, 60, 1.0)], CLIPS), chunks, 1).collect()
    assert sorted((r.from_no, r.to_no, r.value) for r in runs) == [(0, 10, 0.0), (10, 50, 2.0), (50, 60, 3.0), (60, 90_000_000, 2.0), (90_000_000, 100_000_000, 0.0)]


def test_levels(spark):
    checks = spark.createDataFrame([(1, 0, 5, 1, 0, 2, 0, 0, 40, 0, 9), (None, 0, 3, 0, 1, 0, 0, 0, 7, 0, 9)], "video_id long, chunk_index long, " + ", ".join(f"{c} long" for c in fit.SUMMARY) + ", max_abs_drift_ms long, allowed_advance_ms long, total_ms long")
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 0)], "video_id long, chunk_index long")
    got = {(r.level, r.video_id, r.chunk_index): (r.chunks, r.segments, r.clipped, r.max_abs_drift_ms) for r in fit.sync_levels(checks, chunks).collect()}
    assert got == {("chunk", 1, 0): (1, 5, 2, 40), ("chunk", 1, 1): (1, 0, 0, 0), ("chunk", 2, 0): (1, 0, 0, 0), ("chunk", None, 0): (1, 0, 0, 0),
                   ("video", 1, None): (2, 5, 2, 40), ("video", 2, None): (1, 0, 0, 0), ("video", None, None): (1, 0, 0, 0), ("corpus", None, None): (4, 5, 2, 40)}
