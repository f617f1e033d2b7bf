"""Queries over streams: each reads the given tables as a stream, runs to the end of them and returns the sink's table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import r6
from ..operators import ledger
from ..sources import logs
from ..streaming import jobs
from ..streaming.runner import drain, drain_batches, drain_keyed, read_table_stream
from .carriers import DEPENDS, VIEWS, oracle, table, v_series
from .ingest import log_lines
from .narration import six
from .production import CHUNKED
from .registry import gate

HOURS = "(unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 3600000D"
STABLE_SEC, TIMEOUT_SEC = 12.0, 150.0
DELAY_SEC, RETAIN_SEC = 60.0, 86_400.0  # of the watermark; of a finished job
DELAY_LINES = 10_000


def series_stream(spark, d):
    table(spark, d, "events")  # pins the session to UTC
    return series(read_table_stream(spark, f"{d}/events.parquet"))


def series(events):
    return events.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("ord"), (F.rint(F.expr(HOURS)) / F.lit(1000.0)).alias("t_sec"), F.col("value").alias("level"))


@gate("silence_stream", oracle("v_series", """
SELECT video_id, ord AS line_no, greatest(opened, 0::DOUBLE) AS start_sec, t_sec AS end_sec
FROM (SELECT *, lag(CASE WHEN ord % 4 = 0 THEN t_sec - 2 END) OVER (PARTITION BY video_id ORDER BY ord) AS opened
      FROM v_series WHERE ord % 4 IN (0, 1)) WHERE ord % 4 = 1 AND opened IS NOT NULL"""))
def silence_stream(spark, d):
    return drain_keyed(log_lines(series_stream(spark, d)), "silences", "video_id", lambda lines: logs.silences_from_log(lines, "video_id"),
                       life=jobs.silence_lifetime(DELAY_LINES, "video_id"))


def snapshots(s):
    request = F.col("video_id") * 4 + F.floor(F.col("t_sec") / 180).cast("long")
    local = F.col("t_sec") - F.floor(F.col("t_sec") / 180) * 180
    return s.select(
        request.alias("request_id"), "ord", "t_sec", F.timestamp_micros(F.rint(F.col("t_sec") * 1000000).cast("long")).alias("ts"),
        F.when(F.col("level") < 15, "").otherwise(F.concat(F.lit("v"), F.floor(F.col("level") / 60).cast("string"))).alias("text"),
        F.when(local < 5 + (F.col("video_id") % 8) * 10, 0).otherwise(1).alias("count"),
        (F.col("ord") % 11 == 0).alias("generating"), (F.col("ord") % 53 == 0).alias("banner"))


VIEWS["snaps"] = """SELECT video_id * 4 + CAST(floor(t_sec / 180) AS BIGINT) AS request_id, ord, t_sec, CASE WHEN level < 15 THEN '' ELSE 'v' || CAST(floor(level / 60) AS BIGINT) END AS text,
    CASE WHEN t_sec - floor(t_sec / 180) * 180 < 5 + (video_id % 8) * 10 THEN 0 ELSE 1 END AS count, ord % 11 = 0 AS generating, ord % 53 = 0 AS banner FROM v_series"""
VIEWS["snap_rows"] = "SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY t_sec, ord) AS rn FROM snaps"
# one snapshot after the other, all requests in step; phase 0 waits for the answer, 1 watches it, 2 is over
VIEWS["snap_steps"] = """SELECT request_id, 0::BIGINT AS rn, 0 AS phase, t_sec AS start, '' AS cur, t_sec AS stable, t_sec AS last_t, '' AS last_text, '' AS outcome FROM snap_rows WHERE rn = 1
    UNION ALL SELECT r.request_id, r.rn,
      CASE WHEN p.phase = 0 THEN CASE WHEN r.count > 0 THEN 1 WHEN r.banner OR r.t_sec - p.start > 60 THEN 2 ELSE 0 END
           WHEN r.t_sec - p.start >= 150 THEN 2 WHEN r.text <> p.cur OR r.generating THEN 1 WHEN r.text <> '' AND r.t_sec - p.stable >= 12 THEN 2 WHEN r.banner AND r.text = '' THEN 2 ELSE 1 END,
      p.start, CASE WHEN p.phase = 1 THEN r.text ELSE p.cur END, CASE WHEN p.phase = 0 AND r.count > 0 THEN r.t_sec WHEN p.phase = 1 AND (r.text <> p.cur OR r.generating) THEN r.t_sec ELSE p.stable END,
      CASE WHEN p.phase = 1 AND r.t_sec - p.start >= 150 THEN p.last_t ELSE r.t_sec END, CASE WHEN p.phase = 1 AND r.t_sec - p.start >= 150 THEN p.last_text ELSE r.text END,
      CASE WHEN p.phase = 0 THEN CASE WHEN r.count > 0 THEN '' WHEN r.banner THEN 'banner' WHEN r.t_sec - p.start > 60 THEN 'timed_out' ELSE '' END
           WHEN r.t_sec - p.start >= 150 THEN 'timed_out' WHEN r.text <> p.cur OR r.generating THEN '' WHEN r.text <> '' AND r.t_sec - p.stable >= 12 THEN 'settled' WHEN r.banner AND r.text = '' THEN 'banner' ELSE '' END
    FROM snap_steps p JOIN snap_rows r ON r.request_id = p.request_id AND r.rn = p.rn + 1 WHERE p.phase < 2"""
SETTLED_SQL = """SELECT request_id, outcome, last_t AS at_sec, last_text AS text FROM snap_steps WHERE phase = 2
UNION ALL SELECT request_id, CASE WHEN start + 150 <= (SELECT max(t_sec) FROM snaps) THEN 'timed_out' ELSE 'open' END, last_t, last_text
    FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rn DESC) AS r, max(phase) OVER (PARTITION BY request_id) AS top FROM snap_steps) WHERE r = 1 AND top < 2"""
DEPENDS.update({"snaps": ["v_series"], "snap_rows": ["snaps"], "snap_steps": ["snap_rows"]})


@gate("response_settle", oracle("snap_steps snaps", SETTLED_SQL))
def response_settle(spark, d):
    """Judged at the time of the newest snapshot that the stream will bring."""
    now = v_series(spark, d).agg(F.max("t_sec")).first()[0]
    return drain_keyed(snapshots(series_stream(spark, d)), "settled", "request_id", lambda s: jobs.settle(s, STABLE_SEC, TIMEOUT_SEC, now),
                       life=jobs.settle_lifetime(DELAY_SEC, TIMEOUT_SEC))


@gate("response_settle_batch", oracle("snap_steps snaps", SETTLED_SQL))
def response_settle_batch(spark, d):
    return jobs.settle(snapshots(v_series(spark, d)), STABLE_SEC, TIMEOUT_SEC)


def job_events(s):
    m = F.col("ord") % 17
    event = F.when(m <= 1, "start").when(m == 2, "cancel").when(m == 3, "done").when(m == 4, "error").when(m == 5, "clear").otherwise("step")
    return s.select(F.col("video_id").alias("job_id"), "t_sec", "ord", event.alias("event"), m.cast("int").alias("step"))


VIEWS["job_rows"] = """SELECT video_id AS job_id, t_sec, ord, ord % 17 AS m, row_number() OVER (PARTITION BY video_id ORDER BY t_sec, ord) AS rn FROM v_series"""
VIEWS["job_steps"] = """SELECT job_id, 0::BIGINT AS rn, 'none' AS state, NULL::INTEGER AS step, false AS cancel, NULL::DOUBLE AS started, NULL::DOUBLE AS finished, 0::BIGINT AS rejected FROM job_rows WHERE rn = 1
    UNION ALL SELECT job_id, rn, CASE WHEN fresh THEN 'running' WHEN ends THEN CASE WHEN cancel THEN 'cancelled' WHEN m = 3 THEN 'done' ELSE 'error' END WHEN clears THEN 'none' ELSE state END,
      CASE WHEN fresh OR clears THEN NULL WHEN running AND m >= 6 THEN CAST(m AS INTEGER) ELSE step END, CASE WHEN fresh OR clears THEN false WHEN running AND m = 2 THEN true ELSE cancel END,
      CASE WHEN fresh THEN t_sec WHEN clears THEN NULL ELSE started END, CASE WHEN fresh OR clears THEN NULL WHEN ends THEN t_sec ELSE finished END, CASE WHEN running AND m <= 1 THEN rejected + 1 ELSE rejected END
    FROM (SELECT p.*  EXCLUDE (rn), r.rn, r.m, r.t_sec, p.state = 'running' AS running, r.m <= 1 AND p.state <> 'running' AS fresh, p.state = 'running' AND r.m IN (3, 4) AS ends, r.m = 5 AND p.state NOT IN ('none', 'running') AS clears
      FROM job_steps p JOIN job_rows r ON r.job_id = p.job_id AND r.rn = p.rn + 1)"""
JOBS_SQL = """SELECT job_id, state, step, cancel AS cancel_requested, started AS started_sec, finished AS finished_sec, rejected, rn AS events FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY rn DESC) AS r FROM job_steps) WHERE r = 1"""
DEPENDS.update({"job_rows": ["v_series"], "job_steps": ["job_rows"]})


@gate("job_state_stream", oracle("job_steps", JOBS_SQL))
def job_state_stream(spark, d):
    return drain_keyed(job_events(series_stream(spark, d)), "jobs", "job_id", jobs.job_states, life=jobs.job_lifetime(DELAY_SEC, RETAIN_SEC))


@gate("job_state_batch", oracle("job_steps", JOBS_SQL))
def job_state_batch(spark, d):
    return jobs.job_states(job_events(v_series(spark, d)))


@gate("progress_eta", oracle("v_series", f"""
SELECT video_id, done, total, {six('per')} AS sec_per_item, {six('per * (total - done + 1)')} AS eta_sec, {six('done / total')} AS share FROM (
  SELECT *, CASE WHEN done > 1 THEN (t_sec - t0) / (done - 1) ELSE 0 END AS per FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t_sec, ord) AS done, count(*) OVER (PARTITION BY video_id) AS total,
    min(t_sec) OVER (PARTITION BY video_id) AS t0 FROM v_series)) WHERE done = 1 OR done % 8 = 0"""))
def progress_eta(spark, d):
    p = jobs.progress_eta(v_series(spark, d).drop("level"))
    return p.withColumns({c: r6(c) for c in ("sec_per_item", "eta_sec", "share")})


@gate("percent_done", oracle("v_series", f"SELECT video_id, ord, {six('greatest(0, least(100, t_sec / 600 * 100))')} AS percent FROM v_series"))
def percent_done(spark, d):
    s = series_stream(spark, d)
    return drain(s.select("video_id", "ord", r6(jobs.percent_done(F.col("t_sec"), F.lit(600.0))).alias("percent")), "percent")


@gate("ledger_stream", oracle("", f"""
SELECT video_id, count(*) AS chunks, count(*) FILTER (n = 4) AS chunks_done, bool_and(n >= 2) AS all_scripts_ready, bool_and(n >= 3) AS all_speech_ready, coalesce(min(chunk_index) FILTER (n < 4), max(chunk_index)) AS first_unfinished,
    CASE WHEN NOT bool_and(n >= 2) THEN 2 WHEN NOT bool_and(n >= 3) THEN 3 WHEN NOT bool_and(n >= 4) THEN 4 ELSE 5 END AS steps_complete
FROM (SELECT l_orderkey AS video_id, l_linenumber AS chunk_index, ceil(max(l_quantity) / 12.5::DOUBLE) AS n FROM lineitem GROUP BY ALL) GROUP BY video_id"""))
def ledger_stream(spark, d):
    """Finished stages arrive as a stream, each batch appends to the ledger once, and the status is read from the ledger."""
    table(spark, d, "lineitem")
    arrived = read_table_stream(spark, f"{d}/lineitem.parquet").select(
        F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("chunk_index"), F.ceil(F.col("l_quantity") / F.lit(12.5)).cast("int").alias("n_stages"))

    def increment(batch):
        stages = F.explode(F.slice(F.array(*map(F.lit, ledger.STAGES)), F.lit(1), F.col("n_stages"))).alias("stage")
        return ledger.by_chunk(batch).groupBy(*CHUNKED).agg(F.max("n_stages").alias("n_stages")).select(*CHUNKED, stages)

    book = ledger.by_chunk(drain_batches(arrived, "ledger", each=increment).drop("batch_id"))
    return ledger.status_summary(ledger.status_matrix(book, book.select(*CHUNKED).distinct()))


SESSION_SQL = """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events, sum(value) AS value FROM (
    SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events)) GROUP BY user_id, g"""


def session_columns(s):
    us = lambda c: (F.unix_micros(c)).alias(c)
    return s.select("user_id", us("session_start"), us("session_end"), "events", r6("value").alias("value"))


SESSION_COLUMNS = f"user_id, epoch_us(session_start) AS session_start, epoch_us(session_end) AS session_end, events, {six('value')} AS value"


@gate("activity_sessions", f"SELECT {SESSION_COLUMNS} FROM ({SESSION_SQL})")
def activity_sessions(spark, d):
    return session_columns(jobs.activity_sessions(table(spark, d, "events")))


@gate("activity_sessions_stream", f"SELECT {SESSION_COLUMNS} FROM ({SESSION_SQL})")
def activity_sessions_stream(spark, d):
    table(spark, d, "events")
    return session_columns(drain_keyed(read_table_stream(spark, f"{d}/events.parquet"), "sessions", "user_id", jobs.activity_sessions, life=jobs.session_lifetime(3600.0)))
