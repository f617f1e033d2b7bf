"""Ordered operators against brute force where one video holds a large share of the rows and rows are copied."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuespark.operators import fit, highlights, planning, ranges, segments, signal
from cuespark.operators.scan import SLAB_ROWS_CONF, Axis, Lag, Lead, RowNumber, RunLast, RunMax, RunSum, Total, scan
from cuespark.params import HighlightParams, PauseParams, ScriptParams


@pytest.fixture(scope="module")
def samples(spark):
    """A third of the rows belongs to video 0, much of it within a second, with many equal times."""
    rng = random.Random(5)
    data = [(0, i, round(rng.choice([rng.uniform(0, 60), rng.uniform(30, 31)]), 2), rng.choice([10.0, 90.0])) for i in range(600)]
    data += [(1 + i % 12, 1000 + i, round(rng.uniform(0, 60), 2), rng.choice([10.0, 90.0])) for i in range(1200)]
    return spark.createDataFrame(data, "video_id long, ord long, t_sec double, level double").repartition(4).cache()


@pytest.mark.parametrize("slab_rows", ["0", "50"])
def test_scan_equals_plain_windows(spark, samples, slab_rows):
    spark.conf.set(SLAB_ROWS_CONF, slab_rows)
    try:
        held = F.when(F.col("ord") % 5 == 0, F.col("level") + F.col("ord"))
        got = scan(samples, Axis.time("video_id", ("t_sec", "ord")), Lag("lag", "level"), Lead("lead", "ord"), RowNumber("rn"), RunSum("sum", "ord", inclusive=False),
                   RunMax("max", "ord", inclusive=False), RunLast("last", held), RunLast("next", held, ahead=True), Total("n", F.lit(1)))
        w = Window.partitionBy("video_id").orderBy("t_sec", "ord")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        want = samples.select("*", F.lag("level").over(w).alias("lag"), F.lead("ord").over(w).alias("lead"), F.row_number().over(w).cast("long").alias("rn"),
                              F.coalesce(F.sum("ord").over(before), F.lit(0)).alias("sum"), F.max("ord").over(before).alias("max"),
                              F.last(held, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last"),
                              F.first(held, True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("next"),
                              F.count("*").over(Window.partitionBy("video_id")).alias("n"))
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    finally:
        spark.conf.set(SLAB_ROWS_CONF, "0")


@pytest.mark.parametrize("slab_rows", ["0", "40"])
def test_runs_and_merges(spark, samples, slab_rows):
    spark.conf.set(SLAB_ROWS_CONF, slab_rows)
    try:
        local = {}
        for r in samples.collect():
            local.setdefault(r.video_id, []).append((r.t_sec, r.ord, r.level))
        runs, merged = [], []
        for v, items in local.items():
            items.sort()
            cur = None
            for t, _, level in items:
                if cur and cur[0] == (level < 50):
                    cur[2] = t
                else:
                    cur = [level < 50, t, t]
                    runs.append((v, cur))
            spans = sorted((t, t + o % 7 / 10) for t, o, _ in items)
            out = []
            for s, e in spans:
                if out and s - out[-1][1] < 0.05:
                    out[-1][1] = max(out[-1][1], e)
                else:
                    out.append([s, e])
            merged += [(v, s, e) for s, e in out]
        got = signal.level_runs(samples, 50.0)
        assert sorted(map(tuple, got.select("video_id", "quiet", "start_sec", "end_sec").collect())) == sorted((v, c[0], c[1], c[2]) for v, c in runs)
        spans = samples.select("video_id", F.col("t_sec").alias("start_sec"), (F.col("t_sec") + F.col("ord") % 7 / F.lit(10.0)).alias("end_sec"))
        assert sorted(map(tuple, ranges.merge_ranges(spans, "video_id", gap=0.05).select("video_id", "start_sec", "end_sec").collect())) == sorted(merged)
    finally:
        spark.conf.set(SLAB_ROWS_CONF, "0")


@pytest.fixture(scope="module")
def scripts(spark):
    rng = random.Random(9)
    data = []
    for v, n in ((0, 240), (1, 40), (2, 40)):
        for i in range(n):
            s = round(rng.choice([rng.uniform(0, 200), rng.choice([10.0, 20.0, 30.0])]), 2)
            data.append((v, i, s, round(s + rng.choice([0.5, 2.0, 3.0, rng.uniform(0, 8)]), 2), f"t{i}"))
    return spark.createDataFrame(data, "video_id long, id long, start_sec double, end_sec double, text string").repartition(4).cache()


@pytest.mark.parametrize("fold_limit", [2000, 0, 5])
def test_repair_with_crowded_and_copied_rows(scripts, fold_limit):
    want = []
    per = {}
    for r in scripts.collect():
        per.setdefault(r.video_id, []).append(r)
    for v, items in per.items():
        end, n = 5.0, 0
        for r in sorted(items, key=lambda r: (r.start_sec, r.id)):
            s, e = max(5.0, r.start_sec), min(r.end_sec, 180.0)
            if s < end - 1e-3:
                s = end
            if e - s < 1.0:
                continue
            n, end = n + 1, e
            want.append((v, n, r.id, s, e, r.text))
    got = segments.repair_timeline(scripts, low=F.lit(5.0), high=F.lit(180.0), params=ScriptParams(min_segment_sec=1.0), fold_limit=fold_limit)
    assert sorted(map(tuple, got.select("video_id", "id", "src_id", "start_sec", "end_sec", "text").collect())) == sorted(want)


@pytest.mark.parametrize("fold_limit", [2000, 0, 3])
def test_event_spacing(samples, fold_limit):
    want = []
    per = {}
    for r in samples.collect():
        per.setdefault(r.video_id, []).append(r.t_sec)
    for v, times in per.items():
        last = float("-inf")
        for t in sorted(times):
            if t - last >= 1.5:
                want.append((v, t))
                last = t
    events = samples.select("video_id", F.col("ord").alias("idx"), "t_sec")
    assert sorted(map(tuple, signal.spaced_times(events, 1.5, fold_limit=fold_limit).select("video_id", "t_sec").collect())) == sorted(want)


@pytest.mark.parametrize("fold_limit", [2000, 7])
def test_highlights_with_one_crowded_video(spark, fold_limit):
    rng = random.Random(3)
    data = [(0, i, s, s + round(rng.uniform(0.5, 6), 1), float(rng.randint(1, 10))) for i in range(150) for s in [round(rng.choice([rng.uniform(0, 60), 12.0]), 1)]]
    data += [(v, 1000 * v + i, float(9 * i), float(9 * i + 12), float(rng.randint(1, 10))) for v in (1, 2) for i in range(20)]
    want = []
    for v in (0, 1, 2):
        total, chosen = 0.0, []
        for _, o, s, e, score in sorted((r for r in data if r[0] == v), key=lambda r: (-r[4], r[1])):
            if total >= 40.0:
                break
            if any(s < b - 1e-3 and e > a + 1e-3 for a, b in chosen):
                continue
            if e - s > 40.0 - total and chosen:
                e = s + 40.0 - total
            chosen.append((s, e))
            total += e - s
        want += [(v, round(s, 6), round(e, 6)) for s, e in chosen]
    c = spark.createDataFrame(data, "video_id long, ord long, start_sec double, end_sec double, score double").repartition(4)
    b = spark.createDataFrame([(v, 40.0) for v in (0, 1, 2)], "video_id long, budget_sec double")
    got = highlights.select_highlights(c, b, HighlightParams(), fold_limit)
    assert sorted((r.video_id, round(r.start_sec, 6), round(r.end_sec, 6)) for r in got.collect()) == sorted(want)


def best_first(rows, slack):
    """Plain best-first choice over (ord, start, end, score); accepted ranges are looked up in whole seconds."""
    kept, by_second = set(), {}
    for o, s, e, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        near = {k for t in range(int(s), int(e) + 1) for k in by_second.get(t, ())}
        if not any(s < b - slack and e > a + slack for a, b in near):
            kept.add(o)
            for t in range(int(s), int(e) + 1):
                by_second.setdefault(t, []).append((s, e))
    return kept


@pytest.mark.parametrize("shape", ["rising", "falling", "random", "long"])
def test_one_long_chain_of_candidates(spark, monkeypatch, shape):
    """20,000 candidates, each overlapping the next, in at most 20 rounds."""
    rng = random.Random(11)
    score = {"rising": lambda i: i / 100, "falling": lambda i: -i / 100}.get(shape, lambda i: float(rng.randint(1, 500)))
    length = (lambda: rng.choice([1.5, 1.5, 40.0, 900.0])) if shape == "long" else (lambda: 1.5)
    rows = [(i, float(i), i + length(), score(i)) for i in range(20_000)]
    blocks, bucket_rounds = [], []
    in_blocks, winners = highlights._in_blocks, highlights._local_winners
    monkeypatch.setattr(highlights, "BLOCK_ROWS", 3000)
    monkeypatch.setattr(highlights, "_in_blocks", lambda *a: blocks.append(1) or in_blocks(*a))
    monkeypatch.setattr(highlights, "_local_winners", lambda *a: bucket_rounds.append(1) or winners(*a))
    c = spark.createDataFrame([(0, *r) for r in rows], "video_id long, ord long, start_sec double, end_sec double, score double")
    got = highlights.best_disjoint(c, 1e-3).collect()
    assert len(got) == len({r.ord for r in got})
    assert {r.ord for r in got} == best_first(rows, 1e-3)
    assert len(blocks) + len(bucket_rounds) <= 20


def test_blocks_of_candidates_alone(spark):
    """Candidates of all lengths in small blocks, some equal but for their number, some shorter than the slack."""
    rng = random.Random(4)
    rows = [(i, s, s + rng.choice([0.0005, 0.5, 3.0, 3.001, 60.0]), float(rng.randint(1, 9))) for i in range(1500) for s in [round(rng.uniform(0, 300), 3)]]
    c = spark.createDataFrame([(0, *r) for r in rows], "video_id long, ord long, start_sec double, end_sec double, score double")
    numbered = c.withColumn(highlights.ROW, F.col("ord"))
    for block_rows in (40, 300, 5000):
        got = [r.ord for r in highlights._by_blocks(numbered, 1e-3, block_rows).collect()]
        assert sorted(got) == sorted(best_first(rows, 1e-3))


@pytest.mark.parametrize("fold_limit, block", [(2000, 5000), (0, 7)])
def test_pauses_in_a_crowded_video(spark, scripts, monkeypatch, fold_limit, block):
    monkeypatch.setattr(fit, "BLOCK_CLIPS", block)
    clips = scripts.select("video_id", "id", "start_sec", F.lit(2.0).alias("planned_sec"), (F.col("end_sec") - F.col("start_sec")).alias("final_sec"), F.lit(1.0).alias("speed"),
                           F.lit("ok").alias("status"), F.lit(190_000).cast("long").alias("total_ms"))
    params = PauseParams(max_advance_sec=0.5, min_pause_sec=0.1, max_pause_sec=0.4)
    slots = {(r.video_id, r.id): r for r in fit.place_clips(clips).collect()}
    draws = {}
    for tag in "pa":
        d = clips.select("video_id", "id", fit.seeded_uniform(F.concat_ws(":", F.lit(f"7{tag}"), "video_id", "id")).alias("u"))
        draws[tag] = {(r.video_id, r.id): r.u for r in d.collect()}
    want = {}
    for v in (0, 1, 2):
        prev = None
        mine = sorted((r for r in clips.collect() if r.video_id == v), key=lambda r: (r.start_sec, r.id))
        for i, r in enumerate(mine):
            k = (v, r.id)
            if k not in slots:
                continue
            pos, shrink = slots[k].planned_start_ms, 0
            if prev is not None and pos - prev > 0:
                want_ms = max(0, pos - prev - round((0.1 + draws["p"][k] * (0.4 - 0.1)) * 1000))
                shrink = want_ms if want_ms <= 500 else int(draws["a"][k] * 500)
            limit = min(round(mine[i + 1].start_sec * 1000) if i + 1 < len(mine) else 190_000, 190_000)
            prev = pos - shrink + min(slots[k].audio_len_ms, max(0, limit - (pos - shrink)))
            want[k] = (shrink, prev)
    got = {(r.video_id, r.id): (r.pause_shrink_ms, r.placed_end_ms) for r in fit.place_with_pauses(clips, params, fold_limit=fold_limit).collect()}
    assert got == want


def test_scene_batches_of_many_short_windows(spark):
    rng = random.Random(4)
    data, want = [], []
    for v, n in ((0, 60), (1, 9)):
        t, groups = 0.0, []
        for _ in range(n):
            a, t = t, round(t + rng.choice([0.5, 1.0, 2.5, 7.0]), 1)
            k = rng.randint(1, 5)
            data += [(v, a + 0.01 * j, a, t) for j in range(k)]
            groups += [(a, t, min(2, k - 2 * p)) for p in range((k + 1) // 2)]
        open_ = None
        for i, (a, b, k) in enumerate(groups):
            open_ = (open_[0], b, open_[2] + k) if open_ else (a, b, k)
            if b - open_[0] >= 5.0 or i == len(groups) - 1:
                want.append((v, *open_))
                open_ = None
    s = spark.createDataFrame(data, "video_id long, t_sec double, w_start double, w_end double")
    for limit in (2000, 0):
        got = planning.batch_by_scene(s, 5.0, 2, fold_limit=limit)
        assert sorted(map(tuple, got.select("video_id", "start_sec", "end_sec", "samples").collect())) == sorted(want)
