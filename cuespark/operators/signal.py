"""Detection over level and histogram series: silences, voiced ranges, trims, frame distances and scene cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import SilenceParams, WindowParams
from ..session import stage
from .ranges import FOLD_LIMIT, follow, merge_ranges, neighbours, reset_ids, split_by_size
from .scan import Axis, Lag, scan

KEY = "video_id"


def level_runs(samples: DataFrame, threshold: float, order: tuple[str, ...] = ("t_sec", "ord")) -> DataFrame:
    """Maximal runs of samples on one side of the threshold: video_id, quiet, start_sec, end_sec."""
    flagged = samples.select(KEY, *order, (F.col("level") < threshold).alias("quiet"))
    runs = reset_ids(flagged, Axis.time(KEY, order), ["quiet"], lambda cur, prev: ~cur("quiet").eqNullSafe(prev("quiet")), "run")
    return runs.groupBy(KEY, "run", "quiet").agg(F.min(order[0]).alias("start_sec"), F.max(order[0]).alias("end_sec")).drop("run")


def silence_runs(samples: DataFrame, params: SilenceParams = SilenceParams()) -> DataFrame:
    runs = level_runs(samples, params.threshold)
    return runs.filter(F.col("quiet") & (F.col("end_sec") - F.col("start_sec") >= params.min_sec)).drop("quiet")


def voice_ranges(samples: DataFrame, threshold: float, min_gap: float) -> DataFrame:
    """Ranges of samples at or above the threshold; shorter gaps are bridged."""
    loud = level_runs(samples, threshold).filter(~F.col("quiet")).drop("quiet")
    return merge_ranges(stage(loud), KEY, gap=min_gap)


def trim_bounds(samples: DataFrame, threshold: float, keep_sec: float = 0.06, min_sec: float = 0.1) -> DataFrame:
    """Span of each clip without its quiet ends, or the whole clip where less than ``min_sec`` would be left."""
    loud = F.when(F.col("level") >= threshold, F.col("t_sec"))
    s = samples.groupBy(KEY).agg(F.min("t_sec").alias("t0"), F.max("t_sec").alias("t1"), F.min(loud).alias("a"), F.max(loud).alias("b"))
    start, end = F.greatest("t0", F.col("a") - keep_sec), F.least("t1", F.col("b") + keep_sec)
    usable = F.coalesce(end - start >= min_sec, F.lit(False))
    return s.select(KEY, F.when(usable, start).otherwise(F.col("t0")).alias("start_sec"),
                    F.when(usable, end).otherwise(F.col("t1")).alias("end_sec"), usable.alias("trimmed"))


def histogram_distance(a: Column, b: Column) -> Column:
    """Bhattacharyya distance of two L1-normalised histograms."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda acc, x: acc + x)
    product = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda acc, x: acc + x)
    overlap = product / F.sqrt(total(a) * total(b))
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - overlap))


def frame_distances(frames: DataFrame, step: int = 1) -> DataFrame:
    """Distance of every sampled frame to the sampled frame before it (every ``step``-th frame is sampled)."""
    sampled = frames if step == 1 else frames.filter(F.col("idx") % step == 0)
    pairs = scan(sampled, Axis.time(KEY, ("t_sec", "idx")), Lag("prev_hist", "hist"))
    return pairs.filter(F.col("prev_hist").isNotNull()).select(
        KEY, "idx", "t_sec", histogram_distance(F.col("prev_hist"), F.col("hist")).alias("distance"))


def spaced_times(events: DataFrame, min_gap: float, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Greedy thinning: keep an event that lies at least ``min_gap`` after the last kept one.

    An event that far behind the event before it is kept whatever happened earlier, so the rule runs per chain of close
    events: short chains by a fold, long ones by following the path from each event to the next one it allows."""
    chained = reset_ids(events, Axis.time(KEY, ("t_sec", "idx")), ["t_sec"],
                        lambda cur, prev: cur("t_sec") - prev("t_sec") >= min_gap)
    short, long = split_by_size(stage(chained), [KEY], fold_limit)
    times = short.groupBy(KEY, "chain").agg(F.sort_array(F.collect_list("t_sec")).alias("times"))
    zero = F.struct(F.lit(float("-inf")).alias("last"), F.array().cast("array<double>").alias("out"))
    kept = F.aggregate("times", zero, lambda acc, t: F.when(
        t - acc["last"] >= min_gap, F.struct(t.alias("last"), F.concat(acc["out"], F.array(t)).alias("out"))).otherwise(acc), lambda a: a["out"])
    done = times.select(KEY, F.explode(kept).alias("t_sec"))
    return done if long is None else done.unionByName(_spaced_in_long_chains(long, min_gap))


def _spaced_in_long_chains(events: DataFrame, min_gap: float) -> DataFrame:
    """Only the distinct times of a chain matter.  The next time is looked up with a hair's breadth on either side, and
    the difference itself decides between the two, as it does in the fold."""
    times = stage(events.select(KEY, "chain", "t_sec").distinct())
    hair = 1e-9
    marks = times.select(KEY, F.col("chain").alias("c"), F.col("t_sec").alias("t"))
    found = times.withColumn("goal", F.col("t_sec") + (min_gap - hair))
    found = neighbours(found, marks, KEY, "goal", "t", ["c", "t"], level_first=False).drop("prev_c", "prev_t").withColumnsRenamed({"next_c": "c1", "next_t": "t1"})
    found = stage(found.withColumn("goal", F.col("t_sec") + (min_gap + hair)))
    found = neighbours(found, marks, KEY, "goal", "t", ["c", "t"], level_first=False)
    first = F.when((F.col("c1") == F.col("chain")) & (F.col("t1") - F.col("t_sec") >= min_gap), F.col("t1"))
    nxt = F.coalesce(first, F.when(F.col("next_c") == F.col("chain"), F.col("next_t")))
    links = found.select(KEY, F.col("chain.t_sec").alias("chain_t"), F.col("chain.idx").alias("chain_idx"), "t_sec", nxt.alias("after"))
    return follow(links, [KEY, "chain_t", "chain_idx"], "t_sec", "after").select(KEY, "t_sec")


def scene_cuts(frames: DataFrame, params: WindowParams = WindowParams(), step: int = 1) -> DataFrame:
    jumps = frame_distances(frames, step).filter(F.col("distance") > params.scene_threshold)
    return spaced_times(stage(jumps), params.min_scene_sec).select(KEY, (F.rint(F.col("t_sec") * 1000) / 1000.0).alias("t_sec"))
