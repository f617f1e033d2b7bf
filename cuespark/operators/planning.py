"""Chunk planning, sampling windows and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.timecode import format_timestamp
from ..params import ChunkParams, WindowParams
from ..session import stage
from .ranges import FOLD_LIMIT, asof, attach, follow, neighbours, reset_ids, split_by_size
from .scan import Axis, Lead, RowNumber, RunLast, Total, scan

KEY = "video_id"


def cut_points(silences: DataFrame, scene_cuts: DataFrame | None = None) -> DataFrame:
    """Candidate cut times: video_id, t_sec, grade (0 middle of a silence, 1 scene cut)."""
    mids = silences.select(KEY, ((F.col("start_sec") + F.col("end_sec")) / 2).alias("t_sec"), F.lit(0).alias("grade"))
    return mids if scene_cuts is None else mids.unionByName(scene_cuts.select(KEY, "t_sec", F.lit(1).alias("grade")))


def pick_cuts(targets: DataFrame, points: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Best cut near each target (``targets``: video_id, target_sec, min_start, duration_sec).

    Of each grade only the last point up to the target and the first one after it can be best: if one of these lies out of
    bounds, so do those beyond it."""
    found = targets
    for grade in (0, 1):
        marks = points.filter(F.col("grade") == grade).select(KEY, F.col("t_sec").cast("double").alias("t_sec"))
        found = neighbours(found, marks, KEY, "target_sec", "t_sec", ["t_sec"]).withColumnsRenamed({"prev_t_sec": f"__p{grade}", "next_t_sec": f"__n{grade}"})

    def option(grade: int, side: str) -> Column:
        t = F.col(f"__{side}{grade}")
        away = F.abs(t - F.col("target_sec"))
        usable = (away <= params.tolerance_sec) & (t > F.col("min_start")) & (t < F.col("duration_sec"))
        return F.when(usable, F.struct(F.lit(grade).alias("grade"), away.alias("d"), t.alias("t_sec")))

    best = F.least(*[option(g, side) for g in (0, 1) for side in "pn"])
    joined = found.withColumn("b", best)
    reason = F.when(F.col("b").isNull(), "hard").when(F.col("b.grade") == 0, "silence").otherwise("scene")
    return joined.select(KEY, "target_sec", F.coalesce("b.t_sec", "target_sec").alias("cut_sec"), reason.alias("cut_reason"))


def plan_chunks(media: DataFrame, points: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Gapless chunks per video (``media``: video_id, duration_sec).

    The planner walks a video chunk by chunk, so its candidates are gathered per video.  Their number is bounded by the
    length of the video, not by its samples: silences are disjoint with a minimum length and cuts have a minimum gap."""
    lists = points.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("grade", "t_sec"))).alias("cands"))
    m = media.join(lists, KEY, "left").withColumn("cands", F.coalesce("cands", F.array().cast("array<struct<grade:int,t_sec:double>>")))
    dur, target_len, floor_len = F.col("duration_sec"), params.target_sec, params.min_chunk_sec
    chunk_type = "array<struct<chunk_index:int,start_sec:double,end_sec:double,cut_reason:string>>"

    def emit(acc, end: Column, reason: Column, done: Column):
        chunk = F.struct(F.size(acc["out"]).alias("chunk_index"), acc["pos"].alias("start_sec"), end.alias("end_sec"), reason.alias("cut_reason"))
        return F.struct(end.alias("pos"), done.alias("done"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    def best(acc) -> Column:
        aim = acc["pos"] + target_len
        usable = F.filter("cands", lambda c: (c["t_sec"] > acc["pos"] + floor_len) & (c["t_sec"] < dur) & (F.abs(c["t_sec"] - aim) <= params.tolerance_sec))
        return F.array_min(F.transform(usable, lambda c: F.struct(c["grade"].alias("grade"), F.abs(c["t_sec"] - aim).alias("d"), c["t_sec"].alias("t_sec"))))

    def step(acc, _i):
        last = (dur <= target_len) | (dur - acc["pos"] <= target_len * 1.5)
        cut = let(best(acc), lambda b: emit(
            acc, F.greatest(acc["pos"] + floor_len, F.least(F.coalesce(b["t_sec"], acc["pos"] + target_len), dur)),
            F.when(b.isNull(), "hard").when(b["grade"] == 0, "silence").otherwise("scene"), F.lit(False)))
        return F.when(acc["done"] | (acc["pos"] >= dur - 1e-6), acc).when(last, emit(acc, dur, F.lit("final"), F.lit(True))).otherwise(cut)

    zero = F.struct(F.lit(0.0).alias("pos"), F.lit(False).alias("done"), F.array().cast(chunk_type).alias("out"))
    turns = F.sequence(F.lit(1), F.ceil(dur / floor_len).cast("int"))
    return m.filter(dur > 0).select(KEY, F.inline(F.aggregate(turns, zero, step, lambda a: a["out"])))


def _equal_parts(start: Column, end: Column, n: Column) -> Column:
    size = (end - start) / n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        (start + i * size).alias("w_start"), (start + (i + 1) * size).alias("w_end")))


def equal_windows(media: DataFrame, interval: float) -> DataFrame:
    n = F.greatest(F.lit(1), F.rint(F.col("duration_sec") / interval).cast("int"))
    return media.select(KEY, F.posexplode(_equal_parts(F.lit(0.0), F.col("duration_sec"), n)).alias("pos", "w")).select(
        KEY, F.col("pos").alias("window_index"), "w.w_start", "w.w_end")


def scene_windows(media: DataFrame, cuts: DataFrame, params: WindowParams = WindowParams(), keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Sampling windows per key from scene cuts (``media``: keys and duration_sec; ``cuts``: keys and t_sec).

    A scene opens a window when it is long enough and does not start within the minimum length of the beginning; short
    ones extend the window before them.  Long windows are cut into equal parts, and a key with too many windows gets
    ``max_frames`` equal ones instead."""
    bounds = media.select(*keys, F.lit(0.0).alias("t_sec")).unionByName(
        cuts.filter(F.col("t_sec") > 0).select(*keys, "t_sec")).distinct()
    timed = bounds.join(media.select(*keys, "duration_sec"), list(keys)).filter(F.col("t_sec") < F.col("duration_sec"))
    axis = Axis.time(keys, ("t_sec",), 60.0)
    scenes = stage(scan(timed, axis, Lead("next_t", "t_sec")).withColumn("end_t", F.coalesce("next_t", "duration_sec")))
    opens = (F.col("t_sec") == 0) | ((F.col("end_t") - F.col("t_sec") >= params.min_scene_sec) & (F.col("t_sec") >= params.min_scene_sec))
    grouped = scan(scenes, axis, RunLast("opened", F.when(opens, F.col("t_sec"))))
    merged = grouped.groupBy(*keys, "duration_sec", F.col("opened").alias("s")).agg(F.max("end_t").alias("e"), F.count("*").alias("scenes"))
    span = F.col("e") - F.col("s")
    whole = (F.col("scenes") == 1) & (F.col("s") == 0) & (F.col("e") == F.col("duration_sec"))
    parts = F.rint(span / params.interval_sec).cast("int")
    n = F.when(whole, F.greatest(F.lit(1), parts)).when(span > params.max_scene_sec, F.greatest(F.lit(2), parts)).otherwise(1)
    counted = scan(stage(merged.withColumn("n", n)), Axis.time(keys, ("s",), 60.0), Total("total", "n"))
    too_many = F.col("total") > params.max_frames
    usual = counted.filter(~too_many).select(*keys, F.inline(_equal_parts(F.col("s"), F.col("e"), F.col("n"))))
    capped = counted.filter(too_many & (F.col("s") == 0)).select(
        *keys, F.inline(_equal_parts(F.lit(0.0), F.col("duration_sec"), F.lit(params.max_frames))))
    return usual.unionByName(capped)


def windows_in_chunks(chunks: DataFrame, cuts: DataFrame, params: WindowParams = WindowParams()) -> DataFrame:
    """Scene windows of every chunk, planned on chunk-local time and returned on video time."""
    keyed = ("video_id", "chunk_index")
    owned = asof(cuts.select(KEY, "t_sec"), chunks.select(KEY, "chunk_index", F.col("start_sec").alias("t0"), F.col("end_sec").alias("t1")),
                 KEY, "t_sec", "t0", ["chunk_index", "t0", "t1"])
    local = stage(owned).filter((F.col("t_sec") > F.col("t0")) & (F.col("t_sec") < F.col("t1"))).select(
        KEY, "chunk_index", (F.col("t_sec") - F.col("t0")).alias("t_sec"))
    length = chunks.select(*keyed, (F.col("end_sec") - F.col("start_sec")).alias("duration_sec"))
    planned = scene_windows(length, local, params, keyed)
    return planned.join(chunks.select(*keyed, "start_sec"), list(keyed)).select(
        *keyed, (F.col("w_start") + F.col("start_sec")).alias("w_start"), (F.col("w_end") + F.col("start_sec")).alias("w_end"))


def frame_times(windows: DataFrame, params: WindowParams = WindowParams()) -> DataFrame:
    """Centred sample times of each window."""
    span = F.col("w_end") - F.col("w_start")
    k = F.least(F.lit(params.max_frames_per_window), F.greatest(F.lit(1), F.rint(span / params.interval_sec).cast("int")))
    times = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.col("w_start") + (j + 0.5) * span / k)
    return windows.withColumn("t_sec", F.explode(times))


def sampling_grid(media: DataFrame, interval: float) -> DataFrame:
    """Sparse grid of centres with the window around each, clipped to the video."""
    n = F.greatest(F.lit(1), F.rint(F.col("duration_sec") / interval).cast("int"))
    grid = media.select(KEY, "duration_sec", (F.col("duration_sec") / n).alias("step"), F.explode(F.sequence(F.lit(0), n - 1)).alias("grid_index"))
    t = (F.col("grid_index") + 0.5) * F.col("step")
    return grid.select(KEY, "grid_index", t.alias("grid_sec"), F.greatest(F.lit(0.0), t - F.col("step") / 2).alias("w_start"),
                       F.least("duration_sec", t + F.col("step") / 2).alias("w_end"))


def nearest_samples(samples: DataFrame, media: DataFrame, interval: float) -> DataFrame:
    """Sample nearest to the centre of its grid cell: cells do not overlap, so this is one keyed aggregate, no join of pairs."""
    n = F.greatest(F.lit(1), F.rint(F.col("duration_sec") / interval).cast("int"))
    timed = attach(samples, media.select(KEY, (F.col("duration_sec") / n).alias("step"), n.alias("n")), KEY, "inner")
    cell = F.least(F.floor(F.col("t_sec") / F.col("step")).cast("int"), F.col("n") - 1)
    near = timed.select(KEY, cell.alias("grid_index"), "t_sec", "ord", F.abs(F.col("t_sec") - (cell + 0.5) * F.col("step")).alias("d"))
    best = near.groupBy(KEY, "grid_index").agg(F.min(F.struct("d", "t_sec", "ord")).alias("b"))
    return sampling_grid(media, interval).join(best, [KEY, "grid_index"], "left").select(
        KEY, "grid_index", "grid_sec", "w_start", "w_end", F.col("b.ord").alias("sample_ord"), F.col("b.t_sec").alias("sample_sec"))


def batch_fixed(samples: DataFrame, per_batch: int, order: tuple[str, ...] = ("t_sec", "ord")) -> DataFrame:
    """Adds row_no (1-based) and batch (0-based)."""
    return scan(samples, Axis.time(KEY, order), RowNumber("row_no")).withColumn(
        "batch", F.floor((F.col("row_no") - 1) / per_batch).cast("long"))


def batch_by_scene(samples: DataFrame, min_batch_sec: float, max_per_batch: int, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Batches that follow scene windows (``samples``: video_id, t_sec, w_start, w_end).

    Groups are pieces of one window of at most ``max_per_batch`` samples; they are joined forward until long enough.
    After a group that is long enough by itself nothing is pending, so the joining runs per chain of short groups: by a
    fold, or for long chains along the path from each batch start to the next."""
    numbered = scan(samples, Axis.time((KEY, "w_start", "w_end"), ("t_sec",), 60.0), RowNumber("r"))
    groups = numbered.groupBy(KEY, "w_start", "w_end", F.floor((F.col("r") - 1) / max_per_batch).cast("long").alias("piece")).agg(
        F.count("*").alias("n"))
    chained = reset_ids(stage(groups), Axis.time(KEY, ("w_start", "w_end", "piece")), ["w_start", "w_end"],
                        lambda cur, prev: prev("w_end") - prev("w_start") >= min_batch_sec)
    short, long = split_by_size(stage(chained), [KEY], fold_limit)
    done = _join_groups(short, min_batch_sec)
    return done if long is None else done.unionByName(_join_groups_in_long_chains(long, min_batch_sec))


def _join_groups(chained: DataFrame, min_batch_sec: float) -> DataFrame:
    lists = chained.groupBy(KEY, "chain").agg(F.sort_array(F.collect_list(F.struct("w_start", "piece", "w_end", "n"))).alias("groups"))
    kind = "array<struct<start_sec:double,end_sec:double,samples:bigint,groups:int>>"
    zero = F.struct(F.array().cast(kind).alias("out"), F.lit(True).alias("closed"))

    def step(acc, g):
        fresh = F.struct(g["w_start"].alias("start_sec"), g["w_end"].alias("end_sec"), g["n"].alias("samples"), F.lit(1).alias("groups"))
        last = F.element_at(acc["out"], -1)
        longer = F.struct(last["start_sec"].alias("start_sec"), g["w_end"].alias("end_sec"), (last["samples"] + g["n"]).alias("samples"),
                          (last["groups"] + 1).alias("groups"))
        opened = F.struct(F.concat(acc["out"], F.array(fresh)).alias("out"), (g["w_end"] - g["w_start"] >= min_batch_sec).alias("closed"))
        grown = F.struct(F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(longer)).alias("out"),
                         (g["w_end"] - last["start_sec"] >= min_batch_sec).alias("closed"))
        return F.when(acc["closed"], opened).otherwise(grown)

    return lists.select(KEY, F.inline(F.aggregate("groups", zero, step, lambda a: a["out"])))


def _join_groups_in_long_chains(chained: DataFrame, min_batch_sec: float) -> DataFrame:
    """A batch closes at the first group that ends late enough after its start; the group after that starts the next."""
    hair = 1e-9
    axis = Axis.time(KEY, ("w_start", "w_end", "piece"), 60.0)
    at = F.struct("w_start", "w_end", "piece")
    nodes = stage(scan(chained.withColumn("at", at), axis, Lead("following", F.struct("at", "chain"))))
    nodes = nodes.withColumn("following", F.when(F.col("following.chain") == F.col("chain"), F.col("following.at")))
    # of the pieces of a window the first closes the batch
    marks = nodes.groupBy(KEY, F.col("w_end").alias("e")).agg(F.min_by(F.struct("following", "chain"), "at").alias("m")).select(
        KEY, "e", F.col("m.following").alias("then"), F.col("m.chain").alias("c"))
    low = neighbours(nodes.withColumn("goal", F.col("w_start") + (min_batch_sec - hair)), marks, KEY, "goal", "e", ["e", "then", "c"], level_first=False)
    low = stage(low.drop("prev_e", "prev_then", "prev_c").withColumnsRenamed({"next_e": "e1", "next_then": "then1", "next_c": "c1"}))
    both = neighbours(low.withColumn("goal", F.col("w_start") + (min_batch_sec + hair)), marks, KEY, "goal", "e", ["e", "then", "c"], level_first=False)
    exact = (F.col("c1") == F.col("chain")) & (F.col("e1") - F.col("w_start") >= min_batch_sec)
    after = F.when(exact, F.col("then1")).when(F.col("next_c") == F.col("chain"), F.col("next_then"))
    group = ["g1", "g2", "g3"]
    links = stage(both.select(KEY, F.col("chain.w_start").alias("g1"), F.col("chain.w_end").alias("g2"), F.col("chain.piece").alias("g3"), "at", "n", after.alias("after")))
    starts = follow(links, [KEY, *group], "at", "after").select(KEY, "at", F.lit(True).alias("opens"))
    marked = links.join(starts, [KEY, "at"], "left").select(KEY, "at.w_start", "at.w_end", "at.piece", "n", "opens")
    batched = scan(stage(marked), axis, RunLast("batch", F.when(F.col("opens"), at)))
    return batched.groupBy(KEY, "batch").agg(F.min("w_start").alias("start_sec"), F.max("w_end").alias("end_sec"), F.sum("n").alias("samples"),
                                             F.count("*").cast("int").alias("groups")).drop("batch")


def sparse_pick(samples: DataFrame, most: int = 10, order: tuple[str, ...] = ("t_sec", "ord")) -> DataFrame:
    """Evenly thinned samples, at most ``most`` per video (that is what the operator is for)."""
    counted = scan(samples, Axis.time(KEY, order), RowNumber("row_no"), Total("n", F.lit(1)))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / F.least("n", F.lit(most))))
    return counted.filter(((F.col("row_no") - 1) % step == 0) & (F.floor((F.col("row_no") - 1) / step) < most))


def prompt_table(samples: DataFrame, per_batch: int, words_per_sec: float, creativity: float, style: str = "", purpose: str = "",
                 point_of_view: str = "") -> DataFrame:
    """One prompt text per batch of samples: times, range, word cap and the narrative lines that apply."""
    batched = batch_fixed(samples, per_batch)
    listing = F.struct("row_no", F.concat(F.lit("Image "), ((F.col("row_no") - 1) % per_batch + 1).cast("string"), F.lit(": "),
                                          format_timestamp(F.col("t_sec"))).alias("line"))
    b = batched.groupBy(KEY, "batch").agg(F.min("t_sec").alias("t0"), F.max("t_sec").alias("t1"), F.count("*").alias("n"),
                                          F.sort_array(F.collect_list(listing)).alias("l"))
    band = "low" if creativity <= 0.35 else "medium" if creativity <= 0.75 else "high"
    fixed = [f"Creativity: {band}."]
    fixed += [f"Style: {style}."] if style else []
    fixed += [f"Purpose: {purpose}."] if purpose else []
    fixed += [f"Point of view: {point_of_view}."] if point_of_view else []
    cap = F.greatest(F.lit(1), F.floor((F.col("t1") - F.col("t0")) * words_per_sec).cast("int"))
    opening = F.when(F.col("batch") == 0, F.lit("Open with a hook.")).otherwise(F.lit("Continue the story."))
    text = F.concat_ws("\n", F.array_join(F.transform("l", lambda x: x["line"]), "\n"),
                       F.concat(F.lit("Range: "), format_timestamp(F.col("t0")), F.lit(" - "), format_timestamp(F.col("t1"))),
                       F.concat(F.lit("At most "), cap.cast("string"), F.lit(" words.")), *[F.lit(x) for x in fixed], opening)
    return b.select(KEY, "batch", "n", text.alias("prompt"))
