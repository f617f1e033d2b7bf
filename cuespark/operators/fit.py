"""Fitting narration clips into their slots, placing them in whole milliseconds, and checking the result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import seeded_uniform
from ..functions.timecode import millis
from ..params import FitParams, PauseParams
from ..session import stage
from ..sources.documents import pack_documents, unpack_documents, write_documents
from .ranges import FOLD_LIMIT, attach, reset_ids, split_by_size
from .scan import Axis, Lead, RowNumber, scan

KEY = "video_id"
DRIFT_TOLERANCE_MS = 10
BLOCK_CLIPS = 5000
PLACED = ("id", "planned_start_ms", "planned_end_ms", "placed_start_ms", "placed_end_ms", "audio_len_ms", "start_drift_ms",
          "overrun_ms", "clipped_ms", "pause_shrink_ms", "speed", "status")
END_OF_REPORT = 1 << 62
SUMMARY = ("segments", "start_drift_over_tolerance", "overruns", "clipped", "overlaps", "pause_shrunk_segments")


def available_slot(clips: DataFrame, boundary: Column, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Adds available_sec: room up to the next start, or to the boundary for the last clip."""
    nxt = scan(clips, Axis.time(keys, ("start_sec", "id"), 60.0), Lead("__next", "start_sec"))
    return nxt.withColumn("available_sec", F.greatest(F.lit(0.0), F.coalesce(F.col("__next"), boundary) - F.col("start_sec"))).drop("__next")


def time_fit(clips: DataFrame, params: FitParams = FitParams(), actual: str = "raw_sec", target: str = "planned_sec",
             available: str = "available_sec") -> DataFrame:
    """Adds ratio, speed, final_sec, status and retime_factor."""
    c = clips.withColumns({"__t": F.greatest(F.col(target), F.lit(params.min_target_sec)), "__a": F.col(actual)})
    c = c.withColumns({"__room": F.greatest(F.col(available), F.col("__t")), "ratio": F.col("__a") / F.col("__t")})
    top = F.lit(params.max_speedup)
    fits, slight = F.col("__a") <= F.col("__t") + params.slack_sec, F.col("ratio") <= top
    speed = F.when(fits, 1.0).when(slight, F.least(top, F.col("ratio") * 1.003)).otherwise(top)
    c = c.withColumn("speed", speed).withColumn("final_sec", F.when(fits, F.col("__a")).otherwise(F.col("__a") / F.col("speed")))
    over = F.col("final_sec") <= F.col("__room") + params.slack_sec
    worst = "needs_video_retime" if params.allow_retime else "clipped"
    c = c.withColumn("status", F.when(fits, "ok").when(slight, "sped_up").when(over, "overflow").otherwise(worst))
    factor = F.when(F.col("status") == "needs_video_retime", F.col("final_sec") / F.col("__room")).otherwise(1.0)
    return c.withColumn("retime_factor", factor).drop("__t", "__a", "__room")


def fit_report(clips: DataFrame) -> DataFrame:
    """Counts per status, and whether nothing usable came out."""
    names = ("ok", "sped_up", "overflow", "clipped", "needs_video_retime", "failed", "skipped")
    return clips.groupBy(KEY).agg(*[F.count_if(F.col("status") == n).alias(n) for n in names],
                                  F.bool_and(F.col("status").isin("failed", "skipped")).alias("all_failed"))


def _slots(clips: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Usable clips with position, planned end, audio length and the limit set by the next usable start."""
    usable = clips.filter(~F.col("status").isin("failed", "skipped")).withColumns({
        "pos": millis(F.col("start_sec")), "audio_len_ms": millis(F.col("final_sec"))})
    led = scan(usable, Axis.time(keys, ("start_sec", "id"), 60.0), Lead("__next", "pos"))
    return led.withColumns({
        "planned_end_ms": F.col("pos") + millis(F.col("planned_sec")), "limit": F.least(F.coalesce("__next", "total_ms"), F.col("total_ms"))
    }).drop("__next").filter(F.col("pos") < F.col("total_ms"))


def _placed(slots: DataFrame, shrink: Column, keys: tuple[str, ...]) -> DataFrame:
    s = slots.withColumn("pause_shrink_ms", shrink.cast("long")).withColumn("placed_start_ms", F.col("pos") - F.col("pause_shrink_ms"))
    room = F.greatest(F.lit(0).cast("long"), F.col("limit") - F.col("placed_start_ms"))
    s = s.withColumn("clipped_ms", F.greatest(F.lit(0).cast("long"), F.col("audio_len_ms") - room)).withColumns({
        "planned_start_ms": F.col("pos"), "start_drift_ms": F.col("placed_start_ms") - F.col("pos"),
        "placed_end_ms": F.col("placed_start_ms") + F.col("audio_len_ms") - F.col("clipped_ms"),
        "overrun_ms": F.greatest(F.lit(0).cast("long"), F.col("placed_start_ms") + F.col("audio_len_ms") - F.col("planned_end_ms"))})
    return s.select(*keys, "total_ms", *PLACED)


def place_clips(clips: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Every clip at its planned start (``clips`` need id, start_sec, planned_sec, final_sec, speed, status, total_ms)."""
    return _placed(_slots(clips, keys), F.lit(0), keys)


def place_with_pauses(clips: DataFrame, params: PauseParams, keys: tuple[str, ...] = (KEY,), fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Clips moved earlier by at most ``max_advance_sec`` so that pauses follow a seeded draw; shifts never add up.

    A clip depends on the one before only where that clip's own shift could change its pause; elsewhere a chain starts,
    and the sequential rule runs per chain: by a fold, or for long chains block by block."""
    if params.max_advance_ms == 0:
        return place_clips(clips, keys)
    cap = params.max_advance_ms
    draw = lambda tag: seeded_uniform(F.concat_ws(":", F.lit(f"{params.seed}{tag}"), *keys, "id"))
    slots = _slots(clips, keys).withColumns({
        "pause": F.rint((F.lit(params.min_pause_sec) + draw("p") * (params.max_pause_sec - params.min_pause_sec)) * 1000).cast("long"),
        "free": F.floor(draw("a") * cap).cast("long"),
        "end0": F.least(F.col("pos") + F.col("audio_len_ms"), F.greatest("limit", "pos"))})
    slots = stage(slots)

    def settled(cur, prev):
        gap = cur("pos") - prev("end0")
        return (gap - cur("pause") > cap) | (gap + cap <= 0) | (gap + cap - cur("pause") <= 0)

    chained = reset_ids(slots, Axis.time(keys, ("start_sec", "id"), 60.0), ["pos", "end0", "pause"], settled, prev_as={"end0": "prev_end0"})
    short, long = split_by_size(stage(chained), list(keys), fold_limit)
    shrinks = _shrinks_by_fold(short, keys, cap)
    if long is not None:
        shrinks = shrinks.unionByName(_shrinks_in_long_chains(long, keys, cap))
    return _placed(slots.join(shrinks, [*keys, "id"]), F.col("shrink"), keys)


def _shrinks_by_fold(chained: DataFrame, keys: tuple[str, ...], cap: int) -> DataFrame:
    row = F.struct("start_sec", "id", "pos", "audio_len_ms", "limit", "pause", "free", "prev_end0")
    lists = chained.groupBy(*keys, "chain").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    zero = F.struct(F.lit(None).cast("long").alias("prev_end"), F.array().cast("array<struct<id:bigint,shrink:bigint>>").alias("out"))

    def step(acc, x):
        gap = x["pos"] - F.coalesce(acc["prev_end"], x["prev_end0"])
        want = F.greatest(F.lit(0).cast("long"), gap - x["pause"])
        shrink = F.when(gap > 0, F.when(want <= cap, want).otherwise(x["free"])).otherwise(F.lit(0).cast("long"))
        shrink = F.coalesce(shrink, F.lit(0).cast("long"))
        end = F.least(x["pos"] - shrink + x["audio_len_ms"], F.greatest(x["limit"], x["pos"] - shrink))
        return F.struct(end.alias("prev_end"), F.concat(acc["out"], F.array(F.struct(
            x["id"].cast("long").alias("id"), shrink.alias("shrink")))).alias("out"))

    return lists.select(*keys, F.inline(F.aggregate("rows", zero, step, lambda a: a["out"])))


def _shift_states(block: pd.DataFrame, early: np.ndarray, cap: int) -> tuple[np.ndarray, list]:
    """Runs a block for several states at once: ``early`` is how much earlier than unshifted the clip before ended."""
    shifts = []
    for r in block.itertuples(index=False):
        if pd.isna(r.prev_end0):
            shrink = np.zeros_like(early)
        else:
            gap = r.pos - int(r.prev_end0) + early
            want = np.maximum(0, gap - r.pause)
            shrink = np.where(gap > 0, np.where(want <= cap, want, r.free), 0)
        start = r.pos - shrink
        early = r.end0 - np.minimum(start + r.audio_len_ms, np.maximum(r.limit, start))
        shifts.append(shrink)
    return early, shifts


def _shrinks_in_long_chains(chained: DataFrame, keys: tuple[str, ...], cap: int) -> DataFrame:
    """A block of clips maps how early the clip before it ended (0..cap ms) to how early its own last clip ends.  The maps
    of all blocks are made side by side, chained per video (one small array per block), and the blocks run once more."""
    group = ("chain_start", "chain_id")
    flat = chained.select(*keys, F.col("chain.start_sec").alias("chain_start"), F.col("chain.id").alias("chain_id"), "start_sec", F.col("id").cast("long").alias("id"),
                          "pos", "audio_len_ms", "limit", "pause", "free", "end0", "prev_end0")
    numbered = stage(scan(flat, Axis.time((*keys, *group), ("start_sec", "id"), 60.0), RowNumber("__n")).withColumn(
        "block", F.floor((F.col("__n") - 1) / BLOCK_CLIPS).cast("long")).drop("__n"))
    by = [*keys, *group, "block"]
    key_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.select(*by).schema)

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = _shift_states(pdf.sort_values(["start_sec", "id"]), np.arange(cap + 1, dtype="int64"), cap)
        return pdf.head(1)[by].assign(ends=[out.tolist()])

    maps = numbered.groupBy(*by).applyInPandas(table, f"{key_type}, ends array<bigint>")
    lists = maps.groupBy(*keys, *group).agg(F.sort_array(F.collect_list(F.struct("block", "ends"))).alias("maps"))
    zero = F.struct(F.lit(0).cast("long").alias("early"), F.array().cast("array<struct<block:bigint,early:bigint>>").alias("out"))
    entries = lists.select(*keys, *group, F.inline(F.aggregate("maps", zero, lambda acc, m: F.struct(
        F.get(m["ends"], acc["early"].cast("int")).alias("early"),
        F.concat(acc["out"], F.array(F.struct(m["block"].alias("block"), acc["early"].alias("early")))).alias("out")), lambda a: a["out"])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_sec", "id"])
        _, shifts = _shift_states(pdf, pdf["early"].to_numpy()[:1].astype("int64"), cap)
        return pdf[[*keys, "id"]].assign(shrink=[int(s[0]) for s in shifts])

    out_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.select(*keys, "id").schema) + ", shrink bigint"
    return numbered.join(entries, by).groupBy(*by).applyInPandas(run, out_type)


def sync_checks(placed: DataFrame, allowed_ms: int = 0, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Summary per key: unexplained drift, overruns, clips cut, overlaps of neighbours, shifted clips, largest drift."""
    axis = Axis(keys, ("planned_start_ms", "id"), F.floor(F.col("planned_start_ms") / 60000).cast("long"))
    led = scan(placed, axis, Lead("__next", "placed_start_ms"))
    return led.groupBy(*keys).agg(
        F.count("*").alias("segments"),
        F.count_if(F.abs(F.col("start_drift_ms") + F.col("pause_shrink_ms")) > DRIFT_TOLERANCE_MS).alias("start_drift_over_tolerance"),
        F.count_if(F.col("overrun_ms") > 0).alias("overruns"), F.count_if(F.col("clipped_ms") > 0).alias("clipped"),
        F.count_if(F.col("placed_end_ms") > F.col("__next")).alias("overlaps"),
        F.count_if(F.col("pause_shrink_ms") > 0).alias("pause_shrunk_segments"),
        F.max(F.abs("start_drift_ms")).alias("max_abs_drift_ms"), F.lit(allowed_ms).cast("long").alias("allowed_advance_ms"),
        F.max("total_ms").alias("total_ms"))


def on_video_time(placed: DataFrame, chunk_start: str = "chunk_start") -> DataFrame:
    """Chunk-local placements moved to the time of the whole video."""
    offset = millis(F.col(chunk_start))
    return placed.withColumns({c: F.col(c) + offset for c in ("planned_start_ms", "planned_end_ms", "placed_start_ms", "placed_end_ms")})


def sync_rollup(chunk_checks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk summaries added up per video; chunks without a report count as chunks but add nothing."""
    joined = chunks.join(chunk_checks.drop("total_ms"), [KEY, "chunk_index"], "left")
    zero = F.lit(0).cast("long")
    return joined.groupBy(KEY).agg(
        F.count("*").alias("chunks"), F.max(millis(F.col("end_sec"))).alias("total_video_ms"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in SUMMARY], F.coalesce(F.max("max_abs_drift_ms"), zero).alias("max_abs_drift_ms"))


def sync_levels(chunk_checks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Summaries of every chunk, video and the whole corpus, as ``level`` says, from one aggregation by grouping sets."""
    joined = chunks.join(chunk_checks.drop("total_ms"), [KEY, "chunk_index"], "left")
    zero = F.lit(0).cast("long")
    level = F.when(F.grouping(KEY) == 1, "corpus").when(F.grouping("chunk_index") == 1, "video").otherwise("chunk")
    return joined.rollup(KEY, "chunk_index").agg(
        level.alias("level"), F.count("*").alias("chunks"), *[F.coalesce(F.sum(c), zero).alias(c) for c in SUMMARY],
        F.coalesce(F.max("max_abs_drift_ms"), zero).alias("max_abs_drift_ms"))


def qa_checklist(rollup: DataFrame) -> DataFrame:
    """Four pass/fail rows per video."""
    checks = (("no drift over tolerance", "start_drift_over_tolerance"), ("nothing clipped", "clipped"), ("no overlaps", "overlaps"),
              ("no overruns", "overruns"))
    rows = F.array(*[F.struct(F.lit(i).alias("check_no"), F.lit(n).alias("check_name"), (F.col(c) == 0).alias("passed"), F.col(c).alias("found"))
                     for i, (n, c) in enumerate(checks, 1)])
    return rollup.select(KEY, F.inline(rows))


def report_lines(placed: DataFrame, checks: DataFrame) -> DataFrame:
    """The lines of each video's report in JSON: the summary, its segments in order of time, and the end (``n`` orders them)."""
    axis = Axis((KEY,), ("planned_start_ms", "id"), F.floor(F.col("planned_start_ms") / 60000).cast("long"))
    numbered = scan(placed, axis, RowNumber("n"))
    summary = F.struct(*SUMMARY, "max_abs_drift_ms", "allowed_advance_ms")
    head = F.struct(F.col("total_ms").alias("total_video_ms"), summary.alias("summary"))
    opening = F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(', "segments": ['))
    segment = F.concat(F.when(F.col("n") > 1, F.lit(",")).otherwise(F.lit("")), F.to_json(F.struct(*PLACED)))
    ends = checks.select(KEY, F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("n"), opening.alias("line")), F.struct(F.lit(END_OF_REPORT).alias("n"), F.lit("]}").alias("line")))))
    return ends.unionByName(numbered.select(KEY, F.col("n").cast("long").alias("n"), segment.alias("line")))


def write_reports(placed: DataFrame, checks: DataFrame, path: str) -> None:
    """One report file per video, whatever its length."""
    write_documents(report_lines(placed, checks), path, KEY, ["n"], "line")


def pack_reports(placed: DataFrame, checks: DataFrame, path: str) -> None:
    """The report documents of all videos, packed."""
    pack_documents(report_lines(placed, checks), path, KEY, ["n"], "line")


def read_reports(spark: SparkSession, path: str, videos: list | None = None) -> DataFrame:
    """(video_id, document) of packed reports."""
    return unpack_documents(spark, path, KEY, ["n"], "line", videos)
