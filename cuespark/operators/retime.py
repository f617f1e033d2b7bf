"""Slowed windows of a video and the piecewise map from old to new time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .ranges import asof, attach, merge_ranges
from .scan import Axis, Lag, RunSum, scan

KEY = "video_id"
MERGE_GAP_SEC = 0.05


def check_windows(windows: DataFrame, media: DataFrame) -> DataFrame:
    """Adds ``reason`` (null when the window is usable) to video_id, start_sec, end_sec, factor."""
    w = attach(windows, media.select(KEY, "duration_sec"), KEY)
    return w.withColumn("reason", F.when(F.col("end_sec") <= F.col("start_sec"), "empty").when(F.col("factor") <= 1.0, "not slower")
                        .when(F.col("duration_sec").isNull() | (F.col("start_sec") < 0) | (F.col("end_sec") > F.col("duration_sec")), "outside the video"))


def merge_windows(windows: DataFrame, gap: float = MERGE_GAP_SEC) -> DataFrame:
    return merge_ranges(windows.select(KEY, "start_sec", "end_sec", "factor"), KEY, gap=gap, extra={"factor": F.max("factor")})


def partition_timeline(media: DataFrame, merged: DataFrame) -> DataFrame:
    """Gapless pieces of [0, duration] with their factor and start on the new timeline."""
    w = stage(attach(merged, media.select(KEY, "duration_sec"), KEY, "inner"))
    gained = (F.col("end_sec") - F.col("start_sec")) * (F.col("factor") - 1.0)
    timed = scan(w, Axis.time(KEY, ("start_sec", "end_sec"), 60.0), Lag("prev_end", "end_sec"), RunSum("gain", gained, inclusive=False))
    old = F.coalesce("prev_end", F.lit(0.0))
    piece = lambda a, b, f, n: F.struct(a.alias("start_sec"), b.alias("end_sec"), f.alias("factor"), n.alias("new_start"))
    slow = piece(F.col("start_sec"), F.col("end_sec"), F.col("factor"), F.col("start_sec") + F.col("gain"))
    keep = F.when(F.col("start_sec") > old, piece(old, F.col("start_sec"), F.lit(1.0), old + F.col("gain")))
    inner = timed.select(KEY, F.inline(F.array_compact(F.array(keep, slow))))
    last = w.groupBy(KEY).agg(F.max("end_sec").alias("last_end"), F.sum(gained).alias("gained"))
    tail = media.join(last, KEY, "left").withColumns({"last_end": F.coalesce("last_end", F.lit(0.0)), "gained": F.coalesce("gained", F.lit(0.0))})
    tail = tail.filter(F.col("last_end") < F.col("duration_sec")).select(
        KEY, F.col("last_end").alias("start_sec"), F.col("duration_sec").alias("end_sec"), F.lit(1.0).alias("factor"),
        (F.col("last_end") + F.col("gained")).alias("new_start"))
    return inner.unionByName(tail)


def remap(points: DataFrame, pieces: DataFrame, media: DataFrame, t: str = "t_sec") -> DataFrame:
    """Adds new_sec.  The map is continuous, so at a border either piece gives the same time."""
    known = attach(points, media.select(KEY, "duration_sec"), KEY, "inner")
    clamped = known.withColumn("__t", F.greatest(F.lit(0.0), F.least(F.col(t), F.col("duration_sec")))).drop("duration_sec")
    marks = pieces.select(KEY, F.col("start_sec").alias("p_start"), F.col("factor").alias("p_factor"), F.col("new_start").alias("p_new"))
    found = asof(stage(clamped), marks, KEY, "__t", "p_start", ["p_start", "p_factor", "p_new"])
    return found.withColumn("new_sec", F.col("p_new") + (F.col("__t") - F.col("p_start")) * F.col("p_factor")).drop("__t", "p_start", "p_factor", "p_new")


def retimed_duration(media: DataFrame, merged: DataFrame) -> DataFrame:
    gained = merged.groupBy(KEY).agg(F.sum((F.col("end_sec") - F.col("start_sec")) * (F.col("factor") - 1.0)).alias("gained"))
    return media.join(gained, KEY, "left").select(
        KEY, "duration_sec", (F.col("duration_sec") + F.coalesce("gained", F.lit(0.0))).alias("new_duration_sec"))
