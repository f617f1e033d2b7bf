"""Files in and out, engines, and streams that are stopped and resumed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuespark.operators import enrich, ledger, segments, subtitles
from cuespark.plans.carriers import v_segments
from cuespark.sources import logs, scripts
from cuespark.streaming import jobs
from cuespark.streaming.runner import drain_batches, drain_keyed, log_of


def test_script_files_round_trip(spark, sf_dir, tmp_path):
    seg = v_segments(spark, sf_dir).filter("video_id < 5").withColumn("chunk_index", F.lit(0))
    out = str(tmp_path / "script")
    scripts.write_script(scripts.numbered_script(seg), out, by_video=True)
    assert spark.read.json(out).count() == seg.count()
    (tmp_path / "doc.json").write_text('[{"id": 1, "start_time": "0:01", "end_time": "0:02", "text": "x"}]', encoding="utf-8")
    found, _ = scripts.script_rows(scripts.read_script_documents(spark, str(tmp_path / "doc.json")))
    assert segments.coerce_segments(found).filter("reason is null").count() == 1


def test_srt_files(spark, sf_dir, tmp_path):
    cues = subtitles.cue_repair(subtitles.split_cues(v_segments(spark, sf_dir).filter("video_id < 3")))
    subtitles.write_srt(cues, str(tmp_path / "srt"))
    blocks = subtitles.srt_blocks(cues).filter("video_id = 0").orderBy("cue_no").collect()
    files = list((tmp_path / "srt" / "video_id=0").glob("*.txt"))
    assert len(files) == 1 and files[0].read_text(encoding="utf-8") == "".join(b.block + "\n" for b in blocks)
    assert len(list((tmp_path / "srt").glob("*/*.txt"))) == cues.select("video_id").distinct().count()


def test_log_and_frame_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("silence_start: 1\nsilence_end: 3 | silence_duration: 2\nx\ny", encoding="utf-8")
    (tmp_path / "frame_0003_00001500.jpg").write_bytes(b"x")
    (tmp_path / "ff_0001.jpg").write_bytes(b"x")
    lines = logs.read_log_lines(spark, str(tmp_path / "a.log"))
    assert [(r.start_sec, r.end_sec) for r in logs.silences_from_log(lines).collect()] == [(1.0, 3.0)]
    source = lines.select("source").distinct()
    assert [r.line for r in logs.log_tail(source, lines, 2).orderBy("line_no").collect()] == ["x", "y"]
    assert [(r.frame_index, r.timestamp_sec) for r in logs.list_frames(spark, str(tmp_path)).collect()] == [(3, 1.5)]


def test_ledger_increment(spark, tmp_path):
    plan = spark.createDataFrame([("f", 1, c, s) for c in range(2) for s in ledger.STAGES], "fingerprint string, video_id long, chunk_index int, stage string")
    for _ in range(2):  # the same run twice
        ledger.append_increment(plan.filter("chunk_index = 0"), str(tmp_path / "led"), "r1")
    assert spark.read.parquet(str(tmp_path / "led")).count() == 4
    done = spark.read.parquet(str(tmp_path / "led"))
    assert ledger.pending_work(plan, done).count() == 4
    assert ledger.pending_work(plan.withColumn("fingerprint", F.lit("g")), done).count() == 8


def test_engines(spark):
    with pytest.raises(ValueError, match="unknown engine"):
        enrich.engine("nope")
    req = spark.createDataFrame([("a", "one two"), ("a", "one two"), ("b", "bad\x00"), ("c", ""), ("d", "seen")], "content_key string, spoken string")
    cache = spark.createDataFrame([("d", "ok")], "content_key string, status string")
    got = {r.content_key: (r.status, r.duration_sec) for r in enrich.enrich_with_engine(req, "offline_speech", cache, parallelism=2).collect()}
    assert got == {"a": ("ok", 0.83), "b": ("failed", None), "c": ("skipped", None)}


def test_stream_keeps_state_over_restarts(spark, tmp_path):
    """A start in one file and its end in a later one: the second run goes on from the first one's state."""
    src, work = tmp_path / "in", str(tmp_path / "work")
    src.mkdir()
    schema = "video_id long, line_no long, line string"

    def add(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        for f in (tmp_path / name).glob("part-*.parquet"):
            (src / f"{name}-{f.name}").write_bytes(f.read_bytes())

    def run():
        lines = spark.readStream.schema(schema).parquet(str(src))
        return drain_keyed(lines, "silences", "video_id", lambda x: logs.silences_from_log(x, "video_id"), work).collect()

    add("one", [(1, 0, "silence_start: 2.5"), (2, 0, "silence_end: 1 | silence_duration: 1")])
    assert run() == []
    add("two", [(1, 1, "silence_end: 4 | silence_duration: 1.5"), (2, 1, "silence_start: 3")])
    assert [tuple(r) for r in run()] == [(1, 1, 2.5, 4.0)]
    assert len(run()) == 1


@pytest.mark.parametrize("n_files", [1, 2, 7])
def test_streams_do_not_depend_on_batches(spark, tmp_path, n_files):
    """The same events in any number of files, in any order, one file to a micro-batch, give what the whole table gives."""
    rng = random.Random(n_files)
    kinds = ["start", "done", "error", "cancel", "clear", "step", "step"]
    events = [(rng.choice([None, 1, 2, 3]), float(rng.randint(0, 60)), i, rng.choice(kinds), i) for i in range(140)]
    schema = "job_id long, t_sec double, ord long, event string, step int"
    for i in range(n_files):
        part = events[i::n_files] if i % 2 else sorted(events[i::n_files], key=lambda e: -e[1])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    work = str(tmp_path / "work")
    got = drain_keyed(stream, "jobs", "job_id", jobs.job_states, work)
    want = jobs.job_states(spark.createDataFrame(events, schema))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    log = log_of(spark, work)
    assert log.count() == 140 and log.select("batch_id").distinct().count() == n_files
    late = {r.batch_id: r.late for r in jobs.late_rows(log, "t_sec", 10.0).collect()}
    newest, expected = None, {}
    for b in sorted(late):
        times = [r.t_sec for r in log.filter(F.col("batch_id") == b).collect()]
        expected[b] = 0 if newest is None else sum(t < newest - 10.0 for t in times)
        newest = max([*times, *([newest] if newest is not None else [])])
    assert late == expected and (n_files == 1 or sum(late.values()) > 0)


def test_sessions_of_a_hot_and_a_null_user(spark):
    rows = [(1, 1000 * i, 1.0) for i in range(500)] + [(None, 0, 2.0), (None, 1_799, 1.0), (None, 3_599, 1.0), (1, 2_000_000, 5.0)]
    events = spark.createDataFrame(rows, "user_id long, s long, value double").selectExpr("user_id", "timestamp_seconds(s) AS ts", "value")
    got = sorted((r.user_id or 0, r.events, r.value) for r in jobs.activity_sessions(events).collect())
    assert got == [(0, 1, 1.0), (0, 2, 3.0), (1, 1, 5.0), (1, 500, 500.0)]


def test_batches_are_written_once(spark, tmp_path):
    src, work = str(tmp_path / "src"), str(tmp_path / "work")
    spark.range(10).write.parquet(src)
    stream = lambda: spark.readStream.schema("id long").parquet(src)
    assert drain_batches(stream(), "ids", work).count() == 10
    assert drain_batches(stream(), "ids", work).count() == 10
    spark.range(10, 15).write.mode("append").parquet(src)
    assert drain_batches(stream(), "ids", work).select("id").distinct().count() == 15


def test_percent_done(spark):
    df = spark.createDataFrame([(-1.0,), (30.0,), (90.0,)], "t double")
    assert [r.p for r in df.select(jobs.percent_done(F.col("t"), F.lit(60.0)).alias("p")).collect()] == [0.0, 50.0, 100.0]
