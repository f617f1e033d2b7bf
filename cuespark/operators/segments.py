"""Narration segments: coercion, timeline repair, word budgets, audits and their assignment to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import word_limit
from ..functions.text import (CERTAINTY_LEVELS, clean_text, count_words, missing_marks, normalize_certainty,
                              normalize_tone, once, truncate_words)
from ..functions.timecode import parse_timestamp
from ..params import ScriptParams
from ..sources.scripts import RAW_SCHEMA
from ..session import stage
from .ranges import FOLD_LIMIT, asof, attach, chain_ids, follow, neighbours, overlapping, split_by_size
from .scan import Axis, Lag, RowNumber, scan

KEY = "video_id"


def coerce_segments(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Typed segments from raw JSON rows; ``reason`` is null for accepted rows."""
    r = once(rows, {"__r": F.from_json(raw, RAW_SCHEMA)})
    number = F.when(F.col("__r.id").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim("__r.id").try_cast("long"))
    typed = once(r, {
        "id": F.coalesce(number, F.lit(0)), "start_sec": parse_timestamp(F.coalesce("__r.start_time", "__r.start")),
        "end_sec": parse_timestamp(F.coalesce("__r.end_time", "__r.end")), "text": clean_text(F.col("__r.text")),
        "tone": normalize_tone(F.coalesce("__r.tone", "__r.emotion")), "certainty": normalize_certainty(F.col("__r.certainty"))})
    reason = (
        F.when(F.col("__r").isNull(), "not an object").when(F.col("start_sec").isNull() | F.col("end_sec").isNull(), "bad time")
        .when(F.col("text") == "", "empty text").when(F.col("end_sec") <= F.col("start_sec"), "end before start"))
    kept = [c for c in rows.columns if c != raw]
    return typed.select(*kept, "id", "start_sec", "end_sec", "text", "tone", "certainty", reason.alias("reason"))


def clip_to_windows(segments: DataFrame, windows: DataFrame, width: float = 60.0) -> DataFrame:
    """Segments cut to each window they intersect.  ``windows``: video_id, window_id, w_start, w_end (half open)."""
    meets = (F.col("end_sec") > F.col("w_start")) & (F.col("start_sec") < F.col("w_end"))
    pairs = overlapping(segments, windows, KEY, ("start_sec", "end_sec"), ("w_start", "w_end"), meets, width)
    return pairs.withColumns({
        "start_sec": F.greatest("start_sec", "w_start"), "end_sec": F.least("end_sec", "w_end")}).drop("w_start", "w_end")


def _repaired_chains(segments: DataFrame, keys: tuple[str, ...], low: Column | None, high: Column | None, params: ScriptParams,
                     fold_limit: int) -> DataFrame:
    """Kept rows with the chain they belong to.

    Three kinds of rows cannot be kept whatever happens before them and go first: too short ones, copies of a span (only
    the first counts), and rows that end before the end of an earlier row."""
    low = F.lit(0.0) if low is None else low
    s = segments.withColumns({
        "src_start": F.col("start_sec"), "src_id": F.col("id"), "start_sec": F.greatest(low, F.col("start_sec")),
        "end_sec": F.col("end_sec") if high is None else F.least(high, F.col("end_sec"))})
    order = ("src_start", "src_id")
    payload = [c for c in segments.columns if c not in (*keys, "start_sec", "end_sec", "id")]
    spans = [*keys, "src_start", "start_sec", "end_sec"]
    s = s.filter(F.col("end_sec") - F.col("start_sec") >= params.min_segment_sec)
    s = s.groupBy(*spans).agg(F.min_by(F.struct("src_id", *payload), "src_id").alias("first")).select(*spans, "first.*")
    chained = chain_ids(s, Axis.time(keys, order), "start_sec", "end_sec", lambda at, reach: at >= reach - 1e-3, reach_as="reach")
    chained = chained.filter(F.col("reach").isNull() | (F.col("end_sec") > F.col("reach") - 1e-3))
    short, long = split_by_size(stage(chained), list(keys), fold_limit)
    kept = _repair_by_fold(short, keys, payload, segments, params.min_segment_sec)
    return kept if long is None else kept.unionByName(_repair_long_chains(long, keys, payload, params.min_segment_sec))


def _repair_by_fold(chained: DataFrame, keys: tuple[str, ...], payload: list[str], segments: DataFrame, min_sec: float) -> DataFrame:
    row = F.struct("src_start", "src_id", "start_sec", "end_sec", *payload)
    groups = chained.groupBy(*keys, "chain").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    fields = "".join(f",`{c}`:" + segments.schema[c].dataType.simpleString() for c in payload)
    kind = f"array<struct<src_start:double,src_id:bigint,start_sec:double,end_sec:double{fields}>>"

    def step(acc, x):
        start = F.when(x["start_sec"] < acc["prev_end"] - 1e-3, acc["prev_end"]).otherwise(x["start_sec"])
        moved = F.struct(x["src_start"].alias("src_start"), x["src_id"].cast("long").alias("src_id"), start.alias("start_sec"),
                         x["end_sec"].alias("end_sec"), *[x[c].alias(c) for c in payload])
        return F.when(x["end_sec"] - start < min_sec, acc).otherwise(
            F.struct(x["end_sec"].alias("prev_end"), F.concat(acc["out"], F.array(moved)).alias("out")))

    zero = F.struct(F.lit(float("-inf")).alias("prev_end"), F.array().cast(kind).alias("out"))
    kept = groups.select(*keys, F.aggregate("rows", zero, step, lambda a: a["out"]).alias("out"))
    return kept.select(*keys, F.inline("out"))


def _repair_long_chains(chained: DataFrame, keys: tuple[str, ...], payload: list[str], min_sec: float) -> DataFrame:
    """The same by following, from each row, the first later row that would be kept after it: one that starts no earlier
    than its end, or that ends late enough beyond it.  Starts never fall along the order; ends are looked up among the
    rows that end later than all before them."""
    hair = 1e-9
    group = ("chain_start", "chain_id")
    at = F.struct("src_start", "src_id")
    rows = stage(chained.select(*keys, F.col("chain.src_start").alias("chain_start"), F.col("chain.src_id").alias("chain_id"), at.alias("at"),
                                "start_sec", "end_sec", "reach", *payload))
    owner = F.struct(*group)
    # of rows with one start the first counts
    starts = rows.groupBy(*keys, *group, F.col("start_sec").alias("s")).agg(F.min("at").alias("mark")).withColumn("owner", owner)
    ends = rows.filter(F.col("reach").isNull() | (F.col("end_sec") > F.col("reach"))).select(*keys, F.col("end_sec").alias("e"), F.col("at").alias("mark"), owner.alias("owner"))

    def look_up(df: DataFrame, marks: DataFrame, by: str, goal: Column, name: str) -> DataFrame:
        found = neighbours(df.withColumn("__goal", goal), marks, keys, "__goal", by, [by, "mark", "owner"], level_first=False)
        mine = F.col("next_owner") == owner
        return stage(found.select(*df.columns, F.when(mine, F.col("next_mark")).alias(name), F.when(mine, F.col(f"next_{by}")).alias(f"{name}_{by}")))

    nodes = rows.select(*keys, *group, "at", "end_sec")
    nodes = look_up(nodes, starts, "s", F.col("end_sec") - 1e-3, "clear")
    nodes = look_up(nodes, ends, "e", F.col("end_sec") + (min_sec - hair), "low")
    nodes = look_up(nodes, ends, "e", F.col("end_sec") + (min_sec + hair), "high")
    longer = F.when(F.col("low_e") - F.col("end_sec") >= min_sec, F.col("low")).otherwise(F.col("high"))
    links = nodes.select(*keys, *group, "at", F.least("clear", longer).alias("after"))
    kept = follow(links, [*keys, *group], "at", "after")
    chosen = stage(rows.join(kept, [*keys, *group, "at"], "left_semi").select(*keys, *group, "at.src_start", "at.src_id", "start_sec", "end_sec", *payload))
    timed = scan(chosen, Axis.time((*keys, *group), ("src_start", "src_id")), Lag("__prev", "end_sec"))
    moved = F.when(F.col("start_sec") < F.col("__prev") - 1e-3, F.col("__prev")).otherwise(F.col("start_sec"))
    return timed.withColumn("start_sec", moved).select(*keys, "src_start", "src_id", "start_sec", "end_sec", *payload)


def _numbered(kept: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return scan(kept, Axis.time(keys, ("start_sec", "src_start", "src_id"), 60.0), RowNumber("id"))


def repair_timeline(segments: DataFrame, keys: tuple[str, ...] = (KEY,), low: Column | None = None, high: Column | None = None,
                    params: ScriptParams = ScriptParams(), fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Clamps, moves overlapping starts to the previous end, drops what becomes too short, renumbers from 1.

    A segment that starts at or after every earlier end does not depend on what was kept before, so the sequential rule
    runs per chain of overlapping segments and a long video is never held in one task: chains of up to ``fold_limit``
    rows by a fold, longer ones by following the path of kept rows."""
    return _numbered(_repaired_chains(segments, keys, low, high, params, fold_limit), keys).drop("src_start")


def repair_with_errors(segments: DataFrame, keys: tuple[str, ...] = (KEY,), low: Column | None = None, high: Column | None = None,
                       params: ScriptParams = ScriptParams()) -> DataFrame:
    """As ``repair_timeline`` with a ``reason`` column and one error row per script of which nothing is left: one without
    any row that is long enough inside the bounds."""
    start = F.greatest(F.lit(0.0) if low is None else low, F.col("start_sec"))
    end = F.col("end_sec") if high is None else F.least(high, F.col("end_sec"))
    usable = end - start >= params.min_segment_sec
    empty = segments.groupBy(*keys).agg(F.bool_or(usable).alias("any")).filter(~F.col("any")).select(*keys, F.lit("empty script").alias("reason"))
    rows = repair_timeline(segments, keys, low, high, params).withColumn("reason", F.lit(None).cast("string"))
    return rows.unionByName(empty, allowMissingColumns=True)


def word_budget(segments: DataFrame, params: ScriptParams = ScriptParams()) -> DataFrame:
    dur = F.col("end_sec") - F.col("start_sec")
    words = count_words(F.col("text"))
    limit = word_limit(dur, params.words_per_sec, params.wps_tolerance)
    return segments.withColumns({"words": words, "max_words": limit}).withColumns({
        "over_budget": F.col("words") > F.col("max_words"), "words_per_sec": F.col("words") / dur})


def apply_rewrites(segments: DataFrame, rewrites: DataFrame, language: str = "vi") -> DataFrame:
    """Shortened texts by id (``rewrites``: video_id, ord, id as text, text).

    Rows are applied in order and each must be strictly shorter than what stands; that leaves the first row that reaches
    the smallest word count, so a keyed minimum replaces the sequential rule."""
    body = clean_text(F.col("text"))
    usable = rewrites.select(
        KEY, "ord", F.when(F.trim("id").rlike(r"^[+-]?[0-9]+$"), F.trim("id").try_cast("long")).alias("id"), body.alias("text"))
    usable = usable.filter(F.col("id").isNotNull() & (F.col("text") != "") & ~missing_marks(F.col("text"), F.lit(language)))
    usable = usable.withColumn("words", count_words(F.col("text")))
    best = usable.groupBy(KEY, "id").agg(F.min(F.struct("words", "ord", "text")).alias("__best"))
    joined = segments.join(best, [KEY, "id"], "left")
    better = F.coalesce(F.col("__best.words") < count_words(F.col("text")), F.lit(False))
    return joined.withColumns({"rewritten": better, "text": F.when(better, F.col("__best.text")).otherwise(F.col("text"))}).drop("__best")


def enforce_budget(segments: DataFrame, params: ScriptParams = ScriptParams()) -> DataFrame:
    limit = word_limit(F.col("end_sec") - F.col("start_sec"), params.words_per_sec, params.wps_tolerance)
    over = count_words(F.col("text")) > limit
    return segments.withColumns({
        "truncated": over, "text": F.when(over, truncate_words(F.col("text"), limit)).otherwise(F.col("text"))})


def coverage(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """``durations``: video_id, duration_sec."""
    sums = segments.groupBy(KEY).agg(F.sum(F.col("end_sec") - F.col("start_sec")).alias("covered_sec"), F.count("*").alias("segments"))
    return sums.join(durations, KEY).withColumn("share", F.col("covered_sec") / F.greatest("duration_sec", F.lit(1e-6)))


def certainty_audit(segments: DataFrame, params: ScriptParams = ScriptParams()) -> DataFrame:
    label = F.col("certainty")
    counts = segments.groupBy(KEY).agg(*[F.count_if(label == c).alias(c) for c in CERTAINTY_LEVELS], F.count("*").alias("segments"))
    share = F.col("creative_framing") / F.col("segments")
    return counts.withColumn("flagged", (F.lit(params.creativity) <= 0.35) & (share > 0.2))


def assign_to_chunks(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds chunk_index and chunk_start: the chunk that holds the midpoint, the last one beyond the end.

    Chunks cover a video without gaps, so the chunk is the latest one that starts at or before the midpoint."""
    mid = segments.withColumn("__mid", (F.col("start_sec") + F.col("end_sec")) / 2)
    marks = chunks.select(KEY, F.col("start_sec").alias("chunk_start"), "chunk_index")
    return asof(mid, marks, KEY, "__mid", "chunk_start", ["chunk_index", "chunk_start"]).drop("__mid")


def empty_chunks(assigned: DataFrame, chunks: DataFrame) -> DataFrame:
    return chunks.join(assigned.select(KEY, "chunk_index").distinct(), [KEY, "chunk_index"], "left_anti")


def shift_time(df: DataFrame, offset: Column, columns: tuple[str, ...] = ("start_sec", "end_sec")) -> DataFrame:
    return df.withColumns({c: F.col(c) + offset for c in columns})


def story_hook(assigned: DataFrame, chunks: DataFrame, limit: int = 280) -> DataFrame:
    """Hook of each video (its first two texts) on every chunk after the first."""
    first = Window.partitionBy(KEY).orderBy("chunk_index", "start_sec", "id")
    opening = assigned.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= 2).filter(F.col("chunk_index") == 0)
    pair = opening.groupBy(KEY).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("__r", "text"))), lambda x: x["text"]), " ").alias("__text"))
    cut = F.when(F.length("__text") > limit, F.concat(F.substring("__text", 1, limit), F.lit("…"))).otherwise(F.col("__text"))
    return attach(chunks.filter(F.col("chunk_index") > 0).select(KEY, "chunk_index"), pair.select(KEY, cut.alias("hook")), KEY)


def previous_context(segments: DataFrame, per_batch: int, keep: int = 3) -> DataFrame:
    """For every batch of ``per_batch`` lines the last ``keep`` lines before it.  Each line names the batches it feeds."""
    numbered = scan(segments, Axis.time(KEY, ("start_sec", "id")), RowNumber("line_no"))
    batch = F.floor((F.col("line_no") - 1) / per_batch)
    batches = numbered.select(KEY, batch.cast("long").alias("batch")).distinct()
    first, last = F.ceil(F.col("line_no") / per_batch).cast("long"), F.floor((F.col("line_no") + keep - 1) / per_batch).cast("long")
    feeds = numbered.select(KEY, "line_no", "text", F.explode(F.when(first <= last, F.sequence(first, last))).alias("batch"))
    lines = feeds.groupBy(KEY, "batch").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("__l"))
    return batches.join(lines, [KEY, "batch"], "left").select(
        KEY, "batch", F.coalesce(F.array_join(F.transform("__l", lambda x: x["text"]), "\n"), F.lit("")).alias("context"))
