"""Stream jobs.  Each is a function over all rows of the keys it is given, with a rule (``Lifetime``) that says which rows
are final, so that ``runner.drain_keyed`` can let them go.  A result depends on what has arrived within the delay of the
watermark, not on how it was cut into batches or in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import attach, reset_ids
from ..operators.responses import is_blank
from ..operators.scan import Axis, Lag, RowNumber, RunLast, Total, scan
from ..session import stage
from ..sources import logs
from .runner import FINAL, Lifetime


# ---------------------------------------------------------------- rows that came late
def late_rows(log: DataFrame, t: str, delay_sec: float) -> DataFrame:
    """For each micro-batch of a stream's log how many rows were older than the newest row before it by more than the
    delay.  They count in the results all the same."""
    newest = log.groupBy("batch_id").agg(F.max(t).alias("newest"))  # a row for each batch
    before = newest.select("batch_id", F.max("newest").over(Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    late = log.join(before, "batch_id").filter(F.col(t) < F.col("before") - delay_sec)
    return before.select("batch_id").join(late.groupBy("batch_id").agg(F.count("*").alias("late")), "batch_id", "left").select(
        "batch_id", F.coalesce("late", F.lit(0)).alias("late"))


# ---------------------------------------------------------------- when a response is final
def _limits(timeout: float) -> tuple[float, float]:
    return min(60.0, timeout), timeout


def settle(snapshots: DataFrame, stable_sec: float, timeout: float, now_sec: float | None = None) -> DataFrame:
    """First final snapshot per request (``snapshots``: request_id, ord, t_sec, text, count, generating, banner).

    A request without one that has had its total time at ``now_sec`` (the newest snapshot of all unless given) has timed
    out, any other is still ``open``; both report the last snapshot within the time."""
    appear_limit, total_limit = _limits(timeout)
    first = snapshots.groupBy("request_id").agg(F.min("t_sec").alias("start"), F.min(F.when(F.col("count") > 0, F.struct("t_sec", "ord"))).alias("shown"))
    s = attach(snapshots, first, "request_id", "inner")
    early = F.col("shown").isNull() | (F.struct("t_sec", "ord") < F.col("shown"))
    waited = F.col("t_sec") - F.col("start")
    before = s.filter(early & (F.col("banner") | (waited > appear_limit)))
    ended = before.groupBy("request_id").agg(F.min(F.struct("t_sec", "ord", F.when(F.col("banner"), "banner").otherwise("timed_out").alias("outcome"), "text")).alias("e"))
    after = stage(s.filter(~early & (F.struct("t_sec", "ord") > F.col("shown"))))
    axis = Axis.time("request_id", ("t_sec", "ord"), 60.0)
    lagged = stage(scan(after, axis, Lag("__before", "text")))
    changed = (F.col("text") != F.coalesce("__before", F.lit(""))) | F.col("generating")
    timed = scan(lagged, axis, RunLast("__since", F.when(changed, F.col("t_sec"))))
    stable = F.coalesce(F.col("__since"), F.col("shown.t_sec"))
    blank = is_blank(F.col("text"))
    state = (F.when(waited >= total_limit, "timed_out").when(changed, None)
             .when(~blank & (F.col("t_sec") - stable >= stable_sec), "settled").when(F.col("banner") & blank, "banner"))
    marked = timed.withColumn("state", state)
    stops = marked.filter(F.col("state").isNotNull()).groupBy("request_id").agg(F.min(F.struct("t_sec", "ord", F.col("state").alias("outcome"), "text")).alias("e"))
    # the snapshot a total timeout reports is the last one within the time
    within = s.filter(waited < total_limit).groupBy("request_id").agg(F.max(F.struct("t_sec", "ord", "text")).alias("w"))
    now = F.lit(now_sec) if now_sec is not None else snapshots.agg(F.max("t_sec")).scalar()
    r = attach(attach(attach(first, ended, "request_id"), stops.withColumnRenamed("e", "e2"), "request_id"), within, "request_id", "inner")
    e = F.coalesce("e", "e2")
    late = F.col("e").isNull() & (F.col("e2").isNull() | (F.col("e2.outcome") == "timed_out"))
    open_ = e.isNull() & (F.col("start") + total_limit > now)
    return r.select(
        "request_id", F.when(open_, "open").when(late, "timed_out").otherwise(e["outcome"]).alias("outcome"),
        F.when(late, F.col("w.t_sec")).otherwise(e["t_sec"]).alias("at_sec"), F.when(late, F.col("w.text")).otherwise(e["text"]).alias("text"))


# ---------------------------------------------------------------- job states
RUNNING = "running"


def job_states(events: DataFrame) -> DataFrame:
    """Latest state per job (``events``: job_id, t_sec, ord, event, step).

    A start while running is counted and ignored; an end after a cancel request is a cancellation; a finished job can be
    cleared (state none).  Between starts and ends only the latest of the two decides whether a job runs."""
    is_end = F.col("event").isin("done", "error")
    axis = Axis.time("job_id", ("t_sec", "ord"), 60.0)
    turns = scan(events.filter((F.col("event") == "start") | is_end), axis, Lag("before", "event"))
    begins = F.col("event") == "start"
    accepted = begins & ~F.col("before").eqNullSafe("start")
    jobs = turns.groupBy("job_id").agg(F.max(F.when(accepted, F.struct("t_sec", "ord"))).alias("a"), F.count_if(begins & ~accepted).alias("rejected"))
    everyone = events.groupBy("job_id").agg(F.count("*").alias("events"))
    facts = stage(attach(everyone, jobs, "job_id"))
    mine = stage(attach(events, facts.select("job_id", "a"), "job_id", "inner").filter(F.struct("t_sec", "ord") > F.col("a")))
    ends = mine.groupBy("job_id").agg(F.min(F.when(is_end, F.struct("t_sec", "ord", "event"))).alias("f"))
    seen = attach(mine, ends, "job_id", "inner")
    at, end = F.struct("t_sec", "ord"), F.struct(F.col("f.t_sec").alias("t_sec"), F.col("f.ord").alias("ord"))
    live, over = F.col("f").isNull() | (at < end), F.col("f").isNotNull() & (at > end)
    found = seen.groupBy("job_id").agg(
        F.any_value("f").alias("f"), F.bool_or(live & (F.col("event") == "cancel")).alias("cancelled"),
        F.max_by("step", F.when(live & (F.col("event") == "step"), at)).alias("step"), F.bool_or(over & (F.col("event") == "clear")).alias("cleared"))
    j = attach(facts, found, "job_id")
    gone = F.col("a").isNull() | F.coalesce("cleared", F.lit(False))
    flag = ~gone & F.coalesce("cancelled", F.lit(False))
    state = F.when(gone, "none").when(F.col("f").isNull(), RUNNING).when(flag, "cancelled").otherwise(F.col("f.event"))
    keep = lambda c: F.when(~gone, c)
    return j.select("job_id", state.alias("state"), keep(F.col("step")).cast("int").alias("step"), flag.alias("cancel_requested"),
                    keep(F.col("a.t_sec")).alias("started_sec"), keep(F.col("f.t_sec")).alias("finished_sec"),
                    F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"), "events")


# ---------------------------------------------------------------- progress, sessions
def progress_eta(items: DataFrame, every: int = 8) -> DataFrame:
    """Reports at the first and every ``every``-th item: seconds per item and what remains (``items``: video_id, t_sec, ord)."""
    counted = scan(items, Axis.time("video_id", ("t_sec", "ord")), RowNumber("done"), Total("total", F.lit(1)), Total("begun", "t_sec", F.min))
    per = F.when(F.col("done") > 1, (F.col("t_sec") - F.col("begun")) / (F.col("done") - 1)).otherwise(0.0)
    due = (F.col("done") == 1) | (F.col("done") % every == 0)
    return counted.filter(due).select("video_id", "done", "total", per.alias("sec_per_item"), (per * (F.col("total") - F.col("done") + 1)).alias("eta_sec"),
                                      (F.col("done") / F.col("total")).alias("share"))


def percent_done(out_sec: Column, duration_sec: Column) -> Column:
    """Progress of a stream of positions; stateless, so it works on either kind of table."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), out_sec / duration_sec * 100.0))


def activity_sessions(events: DataFrame, gap_sec: float = 1800.0, key: str = "user_id") -> DataFrame:
    """Sessions per key; a pause of ``gap_sec`` closes one.  By an ordered scan, so that no key meets in one task."""
    e = events.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("__us"), "value")
    gap = F.lit(int(gap_sec * 1_000_000))
    axis = Axis((key,), ("__us",), F.floor(F.col("__us") / F.lit(3_600_000_000)).cast("long"))
    chained = reset_ids(e, axis, ["__us"], lambda cur, prev: cur("__us") - prev("__us") >= gap, "__session")
    s = chained.groupBy(key, "__session").agg(F.min("__us").alias("a"), F.max("__us").alias("b"), F.count("*").alias("events"), F.sum("value").alias("value"))
    return s.select(key, F.timestamp_micros("a").alias("session_start"), F.timestamp_micros(F.col("b") + gap).alias("session_end"), "events", "value")


# ---------------------------------------------------------------- when rows of a stream are final
def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def silence_lifetime(delay_lines: int, source: str = "source", line_no: str = "line_no", line: str = "line") -> Lifetime:
    """Lines before the last start behind the watermark are final: an end pairs with nothing before that start.  Line
    numbers count over all logs of the stream and grow along each."""

    def final(lines: DataFrame, watermark: float) -> DataFrame:
        starts = logs.silence_markers(lines, line).filter(F.col("start_at").isNotNull() & (F.col(line_no) < F.lit(watermark)))
        cuts = starts.groupBy(source).agg(F.max(line_no).alias("__cut"))
        return attach(lines, cuts, source).withColumn(FINAL, _is(F.col(line_no) < F.col("__cut")))

    return Lifetime(F.col(line_no), delay_lines, final)


def settle_lifetime(delay_sec: float, timeout: float, linger_sec: float = 86_400.0) -> Lifetime:
    """A request is final when its total time is behind the watermark and it showed an answer, a banner or its lateness
    within that time; one that fell silent before stays open until its next snapshot decides.  Requests do not come back
    later than ``linger_sec`` after they began."""
    appear_limit, total_limit = _limits(timeout)

    def final(snaps: DataFrame, watermark: float) -> DataFrame:
        first = snaps.groupBy("request_id").agg(F.min("t_sec").alias("__start"))
        timed = attach(snaps, first, "request_id")
        waited = F.col("t_sec") - F.col("__start")
        told = _is((waited < total_limit) & ((F.col("count") > 0) | F.col("banner") | (waited > appear_limit)))
        facts = timed.groupBy("request_id").agg((F.bool_or(told) & (F.any_value("__start") + total_limit <= watermark)).alias(FINAL))
        return attach(snaps, facts.withColumn(FINAL, _is(F.col(FINAL))), "request_id")

    return Lifetime(F.col("t_sec"), delay_sec, final, linger_sec)


def job_lifetime(delay_sec: float, retain_sec: float) -> Lifetime:
    """A job that does not run is final ``retain_sec`` after its last event; events that come still later are a job of
    their own, with a row of its own."""

    def final(events: DataFrame, watermark: float) -> DataFrame:
        idle = job_states(events).filter(F.col("state") != RUNNING).select("job_id")
        last = events.groupBy("job_id").agg(F.max("t_sec").alias("__last"))
        old = last.filter(F.col("__last") + retain_sec <= watermark)
        over = old.join(idle.withColumnRenamed("job_id", "__id"), F.col("job_id").eqNullSafe(F.col("__id")), "left_semi")
        return attach(events, over.select("job_id", F.lit(True).alias(FINAL)), "job_id").withColumn(FINAL, _is(F.col(FINAL)))

    return Lifetime(F.col("t_sec"), delay_sec, final)


def session_lifetime(delay_sec: float, gap_sec: float = 1800.0, key: str = "user_id") -> Lifetime:
    """Events are final when their session has ended at the watermark; later sessions of the key are still open."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))

    def final(events: DataFrame, watermark: float) -> DataFrame:
        ends = activity_sessions(events, gap_sec, key).filter(F.unix_micros("session_end") > F.lit(int(watermark)))
        cuts = ends.groupBy(key).agg(F.min(F.unix_micros("session_start")).alias("__cut"))
        return attach(events, cuts, key).withColumn(FINAL, _is(us < F.coalesce("__cut", F.lit(int(watermark)))))

    return Lifetime(us, int(delay_sec * 1_000_000), final)
