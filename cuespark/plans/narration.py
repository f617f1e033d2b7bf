"""Queries over highlights, time fit, placement, retiming and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import r6
from ..functions.text import tokens
from ..functions.timecode import format_timestamp
from ..operators import fit, highlights, retime, segments
from ..operators.ranges import attach, merge_ranges
from ..params import FitParams, HighlightParams, PauseParams, ScriptParams
from ..session import new_folder, stage
from .carriers import DEPENDS, VIEWS, oracle, v_candidates, v_segments, v_series
from .detection import media
from .registry import gate
from .scalars import COMPOSITE_SQL, composite, raw_criteria, tokens_sql
from .script import seg_chunks


def six(sql: str) -> str:
    return f"round_even(({sql}) * 1000000::DOUBLE, 0) / 1000000::DOUBLE"


# ---------------------------------------------------------------- highlights
VIEWS["hl"] = f"""SELECT video_id, ord, CASE WHEN ok THEN greatest(s, 20) END AS start_sec, CASE WHEN ok THEN least(e, 700) END AS end_sec,
    CASE WHEN ok THEN greatest(1, least(10, score)) END AS score,
    CASE WHEN s IS NULL THEN 'bad time or score' WHEN e <= s THEN 'end before start' WHEN NOT ok THEN 'outside the window' END AS reason
  FROM (SELECT *, s IS NOT NULL AND e > s AND least(e, 700) > greatest(s, 20) AS ok FROM (
    SELECT video_id, ord, CASE WHEN ord % 31 <> 0 THEN CAST(round_even(start_sec * 1000, 0) AS BIGINT) // 3600000 * 3600 + CAST(round_even(start_sec * 1000, 0) AS BIGINT) % 3600000 // 60000 * 60
        + CAST(round_even(start_sec * 1000, 0) AS BIGINT) % 60000 / 1000::DOUBLE END AS s,
      CASE WHEN ord % 29 = 0 THEN start_sec - 0.5::DOUBLE ELSE end_sec END AS e, {COMPOSITE_SQL} AS score FROM v_candidates))"""
VIEWS["cand"] = "SELECT video_id, ord, start_sec, end_sec, score FROM hl WHERE reason IS NULL"
# best first over one video at a time, all videos in step
VIEWS["cand_rank"] = "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, ord) AS rn FROM cand"
VIEWS["pick_steps"] = """SELECT video_id, 0::BIGINT AS rn, 0::DOUBLE AS total, []::STRUCT(s DOUBLE, e DOUBLE, o BIGINT)[] AS chosen, duration_sec * 0.4::DOUBLE AS budget FROM media
    UNION ALL SELECT video_id, rn + 1, CASE WHEN take THEN total + (ce - start_sec) ELSE total END,
      CASE WHEN take THEN list_append(chosen, {'s': start_sec, 'e': ce, 'o': ord}) ELSE chosen END, budget
    FROM (SELECT p.*, c.start_sec, c.ord, p.total < p.budget AND len(list_filter(p.chosen, lambda x: c.start_sec < x.e - 0.001::DOUBLE AND c.end_sec > x.s + 0.001::DOUBLE)) = 0 AS take,
        CASE WHEN c.end_sec - c.start_sec > p.budget - p.total AND len(p.chosen) > 0 THEN c.start_sec + (p.budget - p.total) ELSE c.end_sec END AS ce
      FROM pick_steps p JOIN cand_rank c ON c.video_id = p.video_id AND c.rn = p.rn + 1)"""
VIEWS["picked"] = """SELECT video_id, x.s AS start_sec, x.e AS end_sec, x.o AS ord FROM (SELECT video_id, unnest(arg_max(chosen, rn)) AS x FROM pick_steps GROUP BY video_id)"""
VIEWS["kept"] = """SELECT video_id, start_sec, end_sec, false AS fallback FROM picked UNION ALL
    SELECT video_id, 0, duration_sec, true FROM media WHERE video_id NOT IN (SELECT video_id FROM picked)"""
VIEWS["cutlist"] = "SELECT *, coalesce(sum(end_sec - start_sec) OVER (PARTITION BY video_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_start FROM kept"
DEPENDS.update({"hl": ["v_candidates"], "cand": ["hl"], "cand_rank": ["cand"], "pick_steps": ["media", "cand_rank"], "picked": ["pick_steps"],
                "kept": ["picked", "media"], "cutlist": ["kept"]})


def coerced(spark, d):
    raw = raw_criteria(v_candidates(spark, d)).withColumns({
        "start_time": F.when(F.col("ord") % 31 == 0, "soon").otherwise(format_timestamp(F.col("start_sec"))),
        "end_time": F.when(F.col("ord") % 29 == 0, F.col("start_sec") - 0.5).otherwise(F.col("end_sec")).cast("string")})
    return highlights.coerce_highlights(raw.drop("start_sec", "end_sec"), composite(raw), F.lit(20.0), F.lit(700.0)).select(
        "video_id", "ord", "start_sec", "end_sec", "score", "reason")


def selected(spark, d, fold_limit=highlights.FOLD_LIMIT):
    cands = coerced(spark, d).filter(F.col("reason").isNull()).drop("reason")
    budgets = media(spark, d).select("video_id", (F.col("duration_sec") * HighlightParams().budget_ratio).alias("budget_sec"))
    return highlights.select_highlights(cands, budgets, fold_limit=fold_limit)


def kept(spark, d):
    return highlights.with_fallback(stage(selected(spark, d)), media(spark, d))


@gate("coerce_highlights", oracle("hl", f"SELECT video_id, ord, start_sec, end_sec, {six('score')} AS score, reason FROM hl"))
def coerce_highlights(spark, d):
    return coerced(spark, d).withColumn("score", r6("score"))


@gate("select_highlights", oracle("kept", f"SELECT video_id, start_sec, {six('end_sec')} AS end_sec, fallback FROM kept"))
def select_highlights(spark, d):
    return kept(spark, d).withColumn("end_sec", r6("end_sec"))


@gate("highlight_share", oracle("kept media", f"""SELECT video_id, count(*) AS windows, {six('sum(end_sec - start_sec)')} AS kept_sec, {six('sum(end_sec - start_sec) / any_value(duration_sec)')} AS share
FROM kept JOIN media USING (video_id) GROUP BY video_id"""))
def highlight_share(spark, d):
    return highlights.kept_share(kept(spark, d), media(spark, d)).select("video_id", "windows", r6("kept_sec").alias("kept_sec"), r6("share").alias("share"))


@gate("merge_intervals", oracle("v_candidates", """
SELECT video_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS merged FROM (SELECT *, sum(o) OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, ord) AS g FROM (
  SELECT *, CASE WHEN start_sec - max(end_sec) OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.3::DOUBLE THEN 0 ELSE 1 END AS o FROM v_candidates)) GROUP BY video_id, g"""))
def merge_intervals(spark, d):
    return merge_ranges(v_candidates(spark, d), "video_id", gap=0.3, extra={"merged": F.count("*")}, tie="ord")


@gate("cutlist_timeline", oracle("cutlist v_series", f"""
SELECT s.video_id, s.ord, s.t_sec, CASE WHEN s.t_sec < c.end_sec THEN {six('c.new_start + (s.t_sec - c.start_sec)')} END AS new_sec
FROM v_series s ASOF LEFT JOIN cutlist c ON c.video_id = s.video_id AND s.t_sec >= c.start_sec"""))
def cutlist_timeline(spark, d):
    windows = stage(highlights.cutlist(kept(spark, d)))
    return highlights.map_to_cutlist(v_series(spark, d).select("video_id", "ord", "t_sec"), windows).withColumn("new_sec", r6("new_sec"))


# ---------------------------------------------------------------- clips, fit and placement
SPOKEN = "0.28::DOUBLE * greatest(1, len({toks}))"
FIT_SQL = """SELECT {keep}, ratio, CASE WHEN fits THEN 1 WHEN ratio <= 1.25 THEN least(1.25::DOUBLE, ratio * 1.003::DOUBLE) ELSE 1.25::DOUBLE END AS speed,
    CASE WHEN fits THEN 'ok' WHEN ratio <= 1.25 THEN 'sped_up' WHEN raw_sec / 1.25::DOUBLE <= greatest(available_sec, target) + 0.02::DOUBLE THEN 'overflow' ELSE '{worst}' END AS status,
    greatest(available_sec, target) AS room
  FROM (SELECT *, raw_sec / target AS ratio, raw_sec <= target + 0.02::DOUBLE AS fits FROM (SELECT *, greatest(planned_sec, 0.3::DOUBLE) AS target FROM {source}))"""
VIEWS["v_clips"] = f"""SELECT video_id, id, text, start_sec, end_sec - start_sec AS planned_sec, {SPOKEN.format(toks=tokens_sql('text'))} AS raw_sec,
    CASE WHEN (video_id + id) % 19 = 0 THEN 'failed' WHEN (video_id + id) % 23 = 0 THEN 'skipped' END AS engine_status FROM v_segments"""
VIEWS["seg_total"] = "SELECT video_id, max(start_sec) + 9 AS total_sec FROM v_segments GROUP BY video_id"
VIEWS["slots"] = """SELECT c.*, total_sec, greatest(0, coalesce(lead(start_sec) OVER (PARTITION BY video_id ORDER BY start_sec, id), total_sec) - start_sec) AS available_sec
    FROM v_clips c JOIN seg_total USING (video_id)"""
VIEWS["fitted"] = "SELECT *, CASE WHEN status = 'ok' THEN raw_sec ELSE raw_sec / speed END AS final_sec FROM (" + FIT_SQL.format(
    keep="video_id, id, start_sec, planned_sec, raw_sec, available_sec, total_sec, engine_status", worst="clipped", source="slots") + ")"
VIEWS["usable"] = """SELECT *, CAST(round_even(start_sec * 1000, 0) AS BIGINT) AS pos, CAST(round_even(final_sec * 1000, 0) AS BIGINT) AS len, CAST(round_even(total_sec * 1000, 0) AS BIGINT) AS total_ms,
    CAST(round_even(planned_sec * 1000, 0) AS BIGINT) AS planned_ms FROM fitted WHERE engine_status IS NULL"""
VIEWS["usable_lim"] = "SELECT *, least(coalesce(lead(pos) OVER (PARTITION BY video_id ORDER BY start_sec, id), total_ms), total_ms) AS lim FROM usable"
PLACED_SQL = """video_id, total_ms, id, pos AS planned_start_ms, pos + planned_ms AS planned_end_ms, pos - shrink AS placed_start_ms,
    pos - shrink + least(len, greatest(0, lim - (pos - shrink))) AS placed_end_ms, len AS audio_len_ms, -shrink AS start_drift_ms,
    greatest(0, pos - shrink + len - (pos + planned_ms)) AS overrun_ms, greatest(0, len - greatest(0, lim - (pos - shrink))) AS clipped_ms, shrink AS pause_shrink_ms, speed, status"""
VIEWS["placed"] = f"SELECT {PLACED_SQL} FROM (SELECT *, 0::BIGINT AS shrink FROM usable_lim) WHERE pos < total_ms"
VIEWS["pause_rows"] = """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, id) AS rn,
    CAST(round_even((0.3::DOUBLE + ('0x' || substr(md5('7p:' || video_id || ':' || id), 1, 8))::BIGINT / 4294967296::DOUBLE * (1.2::DOUBLE - 0.3::DOUBLE)) * 1000, 0) AS BIGINT) AS pause,
    CAST(floor(('0x' || substr(md5('7a:' || video_id || ':' || id), 1, 8))::BIGINT / 4294967296::DOUBLE * 800) AS BIGINT) AS free
    FROM usable_lim WHERE pos < total_ms"""
VIEWS["pause_steps"] = """SELECT video_id, rn, id, 0::BIGINT AS shrink, pos + least(len, greatest(0, lim - pos)) AS prev_end FROM pause_rows WHERE rn = 1
    UNION ALL SELECT video_id, rn, id, shrink, pos - shrink + least(len, greatest(0, lim - (pos - shrink))) FROM (SELECT r.video_id, r.rn, r.id, r.pos, r.len, r.lim,
      CASE WHEN r.pos - p.prev_end <= 0 THEN 0 WHEN greatest(0, r.pos - p.prev_end - r.pause) <= 800 THEN greatest(0, r.pos - p.prev_end - r.pause) ELSE r.free END AS shrink
      FROM pause_steps p JOIN pause_rows r ON r.video_id = p.video_id AND r.rn = p.rn + 1)"""
VIEWS["paused"] = f"SELECT {PLACED_SQL} FROM (SELECT u.*, s.shrink FROM pause_rows u JOIN pause_steps s USING (video_id, rn))"
DEPENDS.update({"v_clips": ["v_segments"], "seg_total": ["v_segments"], "slots": ["v_clips", "seg_total"], "fitted": ["slots"], "usable": ["fitted"],
                "usable_lim": ["usable"], "placed": ["usable_lim"], "pause_rows": ["usable_lim"], "pause_steps": ["pause_rows"], "paused": ["pause_rows", "pause_steps"]})


def checks_sql(source: str, keys: str = "video_id", allowed: int = 0) -> str:
    return f"""SELECT {keys}, count(*) AS segments, count(*) FILTER (abs(start_drift_ms + pause_shrink_ms) > 10) AS start_drift_over_tolerance, count(*) FILTER (overrun_ms > 0) AS overruns,
    count(*) FILTER (clipped_ms > 0) AS clipped, count(*) FILTER (placed_end_ms > nxt) AS overlaps, count(*) FILTER (pause_shrink_ms > 0) AS pause_shrunk_segments,
    max(abs(start_drift_ms)) AS max_abs_drift_ms, {allowed}::BIGINT AS allowed_advance_ms, max(total_ms) AS total_ms
    FROM (SELECT *, lead(placed_start_ms) OVER (PARTITION BY {keys} ORDER BY planned_start_ms, id) AS nxt FROM {source}) GROUP BY {keys}"""


def clips(spark, d):
    engine = F.when((F.col("video_id") + F.col("id")) % 19 == 0, "failed").when((F.col("video_id") + F.col("id")) % 23 == 0, "skipped")
    return v_segments(spark, d).select(
        "video_id", "id", "start_sec", (F.col("end_sec") - F.col("start_sec")).alias("planned_sec"),
        (F.greatest(F.lit(1), F.size(tokens(F.col("text")))) * F.lit(0.28)).alias("raw_sec"), engine.alias("engine_status"))


def slots(spark, d):
    total = v_segments(spark, d).groupBy("video_id").agg((F.max("start_sec") + 9).alias("total_sec"))
    return fit.available_slot(attach(clips(spark, d), total, "video_id", "inner"), F.col("total_sec"))


def fitted(spark, d, params=FitParams()):
    f = fit.time_fit(slots(spark, d), params)
    return f.withColumns({"status": F.coalesce("engine_status", "status"), "total_ms": F.rint(F.col("total_sec") * 1000).cast("long")})


def placed(spark, d):
    return fit.place_clips(stage(fitted(spark, d)))


PAUSES = PauseParams(max_advance_sec=0.8)


def paused(spark, d):
    return fit.place_with_pauses(stage(fitted(spark, d)), PAUSES)


@gate("available_slot", oracle("slots", "SELECT video_id, id, start_sec, available_sec FROM slots"))
def available_slot(spark, d):
    return slots(spark, d).select("video_id", "id", "start_sec", "available_sec")


def fit_columns(df):
    return df.select("video_id", "id", r6("ratio").alias("ratio"), r6("speed").alias("speed"), r6("final_sec").alias("final_sec"), "status", r6("retime_factor").alias("retime_factor"))


@gate("time_fit", oracle("fitted", f"SELECT video_id, id, {six('ratio')} AS ratio, {six('speed')} AS speed, {six('final_sec')} AS final_sec, status, 1::DOUBLE AS retime_factor FROM fitted"))
def time_fit(spark, d):
    return fit_columns(fit.time_fit(slots(spark, d)))


@gate("time_fit_retime", oracle("slots", f"""SELECT video_id, id, {six('ratio')} AS ratio, {six('speed')} AS speed, {six("CASE WHEN status = 'ok' THEN raw_sec ELSE raw_sec / speed END")} AS final_sec, status,
    CASE WHEN status = 'needs_video_retime' THEN {six('raw_sec / speed / room')} ELSE 1 END AS retime_factor FROM ({FIT_SQL.format(keep='video_id, id, raw_sec', worst='needs_video_retime', source='slots')})"""))
def time_fit_retime(spark, d):
    return fit_columns(fit.time_fit(slots(spark, d), FitParams(allow_retime=True)))


@gate("fit_report", oracle("fitted", """
SELECT video_id, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'sped_up') AS sped_up, count(*) FILTER (s = 'overflow') AS overflow, count(*) FILTER (s = 'clipped') AS clipped,
    count(*) FILTER (s = 'needs_video_retime') AS needs_video_retime, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'skipped') AS skipped, bool_and(s IN ('failed', 'skipped')) AS all_failed
FROM (SELECT video_id, coalesce(engine_status, status) AS s FROM fitted) GROUP BY video_id"""))
def fit_report(spark, d):
    return fit.fit_report(fitted(spark, d))


@gate("place_clips", oracle("placed", f"SELECT * REPLACE ({six('speed')} AS speed) FROM placed"))
def place_clips(spark, d):
    return placed(spark, d).withColumn("speed", r6("speed"))


@gate("place_with_pauses", oracle("paused", f"SELECT * REPLACE ({six('speed')} AS speed) FROM paused"))
def place_with_pauses(spark, d):
    return paused(spark, d).withColumn("speed", r6("speed"))


@gate("sync_checks", oracle("placed", checks_sql("placed")))
def sync_checks(spark, d):
    return fit.sync_checks(stage(placed(spark, d)))


@gate("sync_checks_paused", oracle("paused", checks_sql("paused", allowed=800)))
def sync_checks_paused(spark, d):
    return fit.sync_checks(stage(paused(spark, d)), PAUSES.max_advance_ms)


@gate("sync_report_sink", oracle("placed", f"""
SELECT p.video_id, any_value(c.total_ms) AS total_video_ms, any_value(c.segments) AS all_segments, any_value(c.overruns) AS overruns, count(*) AS listed_segments, CAST(sum(placed_end_ms - placed_start_ms) AS BIGINT) AS spoken_ms,
    string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY planned_start_ms, p.id) AS ids
FROM placed p JOIN c USING (video_id) GROUP BY ALL""", [f"c AS ({checks_sql('placed')})"]))
def sync_report_sink(spark, d):
    """The report documents, packed into files, as a reader finds them."""
    rows, path = stage(placed(spark, d)), new_folder(spark, "reports")
    fit.pack_reports(rows, fit.sync_checks(rows), path)
    schema = "struct<total_video_ms:bigint,summary:struct<segments:bigint,overruns:bigint>,segments:array<struct<id:bigint,placed_start_ms:bigint,placed_end_ms:bigint>>>"
    r = fit.read_reports(spark, path).withColumn("r", F.from_json("document", schema))
    spoken = F.aggregate("r.segments", F.lit(0).cast("long"), lambda acc, s: acc + s["placed_end_ms"] - s["placed_start_ms"])
    return r.select(F.col("video_id").cast("long").alias("video_id"), F.col("r.total_video_ms"), F.col("r.summary.segments").alias("all_segments"), F.col("r.summary.overruns"),
                    F.size("r.segments").cast("long").alias("listed_segments"), spoken.alias("spoken_ms"),
                    F.array_join(F.transform("r.segments", lambda s: s["id"].cast("string")), ",").alias("ids"))


# ---------------------------------------------------------------- the whole narration path, chunk by chunk
VIEWS["np_rows"] = """SELECT a.video_id, a.chunk_index, a.id, a.text, c.start_sec AS lo, c.end_sec AS hi, greatest(a.start_sec, c.start_sec) AS s0, least(a.end_sec, c.end_sec) AS e0,
    row_number() OVER (PARTITION BY a.video_id, a.chunk_index ORDER BY a.start_sec, a.id) AS rn FROM seg_assigned a JOIN seg_chunks c USING (video_id, chunk_index)"""
VIEWS["np_steps"] = """SELECT video_id, chunk_index, 0::BIGINT AS rn, lo AS prev_end, 0::DOUBLE AS s, 0::DOUBLE AS e, false AS kept FROM np_rows WHERE rn = 1
    UNION ALL SELECT video_id, chunk_index, rn, CASE WHEN e0 - s >= 1 THEN e0 ELSE prev_end END, s, e0, e0 - s >= 1 FROM (SELECT r.*, p.prev_end, CASE WHEN r.s0 < p.prev_end - 0.001::DOUBLE THEN p.prev_end ELSE r.s0 END AS s
      FROM np_steps p JOIN np_rows r ON r.video_id = p.video_id AND r.chunk_index = p.chunk_index AND r.rn = p.rn + 1)"""
VIEWS["np_clips"] = f"""SELECT k.video_id, k.chunk_index, row_number() OVER w AS id, k.s - r.lo AS start_sec, (k.e - r.lo) - (k.s - r.lo) AS planned_sec, r.hi - r.lo AS total_sec,
    {SPOKEN.format(toks=tokens_sql('r.text'))} AS raw_sec, greatest(0, coalesce(lead(k.s - r.lo) OVER w, r.hi - r.lo) - (k.s - r.lo)) AS available_sec
    FROM np_steps k JOIN np_rows r USING (video_id, chunk_index, rn) WHERE k.kept WINDOW w AS (PARTITION BY k.video_id, k.chunk_index ORDER BY k.s, k.rn)"""
VIEWS["np_fit"] = "SELECT *, CASE WHEN status = 'ok' THEN raw_sec ELSE raw_sec / speed END AS final_sec FROM (" + FIT_SQL.format(
    keep="video_id, chunk_index, id, start_sec, planned_sec, raw_sec, total_sec", worst="clipped", source="np_clips") + ")"
VIEWS["np_use"] = """SELECT *, CAST(round_even(start_sec * 1000, 0) AS BIGINT) AS pos, CAST(round_even(final_sec * 1000, 0) AS BIGINT) AS len, CAST(round_even(total_sec * 1000, 0) AS BIGINT) AS total_ms,
    CAST(round_even(planned_sec * 1000, 0) AS BIGINT) AS planned_ms, 0::BIGINT AS shrink FROM np_fit"""
VIEWS["np_lim"] = "SELECT *, least(coalesce(lead(pos) OVER (PARTITION BY video_id, chunk_index ORDER BY start_sec, id), total_ms), total_ms) AS lim FROM np_use"
VIEWS["np_placed"] = f"SELECT chunk_index, {PLACED_SQL} FROM np_lim WHERE pos < total_ms"
VIEWS["np_checks"] = checks_sql("np_placed", "video_id, chunk_index")
VIEWS["np_rollup"] = """SELECT c.video_id, count(*) AS chunks, max(CAST(round_even(c.end_sec * 1000, 0) AS BIGINT)) AS total_video_ms, """ + ", ".join(
    f"CAST(coalesce(sum(k.{n}), 0) AS BIGINT) AS {n}" for n in fit.SUMMARY) + """, coalesce(max(k.max_abs_drift_ms), 0) AS max_abs_drift_ms
    FROM seg_chunks c LEFT JOIN np_checks k USING (video_id, chunk_index) GROUP BY c.video_id"""
DEPENDS.update({"np_rows": ["seg_assigned", "seg_chunks"], "np_steps": ["np_rows"], "np_clips": ["np_steps", "np_rows"], "np_fit": ["np_clips"], "np_use": ["np_fit"],
                "np_lim": ["np_use"], "np_placed": ["np_lim"], "np_checks": ["np_placed"], "np_rollup": ["seg_chunks", "np_checks"]})
CHUNKED = ("video_id", "chunk_index")


def narration_placed(spark, d):
    """Assign to chunks, repair inside the chunk, move to local time, fit and place."""
    owner = seg_chunks(spark, d)
    given = segments.assign_to_chunks(v_segments(spark, d), owner).join(
        owner.select(*CHUNKED, F.col("end_sec").alias("chunk_end")), list(CHUNKED)).drop("tone", "certainty")
    fixed = segments.repair_timeline(stage(given), CHUNKED, F.col("chunk_start"), F.col("chunk_end"), ScriptParams())
    local = segments.shift_time(stage(fixed), -F.col("chunk_start"))
    ready = local.withColumns({"planned_sec": F.col("end_sec") - F.col("start_sec"), "raw_sec": F.greatest(F.lit(1), F.size(tokens(F.col("text")))) * F.lit(0.28),
                               "total_sec": F.col("chunk_end") - F.col("chunk_start")}).drop("text", "src_id")
    fitted_ = fit.time_fit(fit.available_slot(ready, F.col("total_sec"), CHUNKED))
    timed = fitted_.withColumn("total_ms", F.rint(F.col("total_sec") * 1000).cast("long"))
    return stage(fit.place_clips(timed, CHUNKED))


def rollup(spark, d):
    return fit.sync_rollup(fit.sync_checks(narration_placed(spark, d), keys=CHUNKED), seg_chunks(spark, d))


@gate("sync_rollup", oracle("np_rollup", "SELECT * FROM np_rollup"))
def sync_rollup(spark, d):
    return rollup(spark, d)


@gate("sync_rollup_levels", oracle("np_rollup", """
SELECT c.video_id, c.chunk_index, CASE WHEN grouping(c.video_id) = 1 THEN 'corpus' WHEN grouping(c.chunk_index) = 1 THEN 'video' ELSE 'chunk' END AS level, count(*) AS chunks, """ + ", ".join(
    f"CAST(coalesce(sum(k.{n}), 0) AS BIGINT) AS {n}" for n in fit.SUMMARY) + """, coalesce(max(k.max_abs_drift_ms), 0) AS max_abs_drift_ms
FROM seg_chunks c LEFT JOIN np_checks k ON k.video_id = c.video_id AND k.chunk_index = c.chunk_index GROUP BY ROLLUP (c.video_id, c.chunk_index)"""))
def sync_rollup_levels(spark, d):
    return fit.sync_levels(fit.sync_checks(narration_placed(spark, d), keys=CHUNKED), seg_chunks(spark, d))


@gate("placed_on_video_time", oracle("np_placed", """SELECT video_id, chunk_index, id, planned_start_ms + chunk_index * 60000 AS planned_start_ms, planned_end_ms + chunk_index * 60000 AS planned_end_ms,
    placed_start_ms + chunk_index * 60000 AS placed_start_ms, placed_end_ms + chunk_index * 60000 AS placed_end_ms FROM np_placed"""))
def placed_on_video_time(spark, d):
    p = narration_placed(spark, d).withColumn("chunk_start", F.col("chunk_index") * F.lit(60.0))
    return fit.on_video_time(p).select(*CHUNKED, "id", "planned_start_ms", "planned_end_ms", "placed_start_ms", "placed_end_ms")


@gate("qa_checklist", oracle("np_rollup", """
SELECT video_id, 1 AS check_no, 'no drift over tolerance' AS check_name, start_drift_over_tolerance = 0 AS passed, start_drift_over_tolerance AS found FROM np_rollup
UNION ALL SELECT video_id, 2, 'nothing clipped', clipped = 0, clipped FROM np_rollup UNION ALL SELECT video_id, 3, 'no overlaps', "overlaps" = 0, "overlaps" FROM np_rollup
UNION ALL SELECT video_id, 4, 'no overruns', overruns = 0, overruns FROM np_rollup"""))
def qa_checklist(spark, d):
    return fit.qa_checklist(rollup(spark, d))


# ---------------------------------------------------------------- retiming
VIEWS["rt_checked"] = """SELECT c.video_id, c.ord, c.start_sec, e AS end_sec, f AS factor, CASE WHEN e <= c.start_sec THEN 'empty' WHEN f <= 1 THEN 'not slower' WHEN e > m.duration_sec THEN 'outside the video' END AS reason
    FROM (SELECT *, CASE WHEN ord % 37 = 0 THEN start_sec ELSE start_sec + (end_sec - start_sec) / 4 END AS e, 1 + (ord % 4) * 0.2718281828459::DOUBLE AS f FROM v_candidates) c JOIN media m USING (video_id)"""
VIEWS["rt_merged"] = """SELECT video_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, max(factor) AS factor FROM (SELECT *, sum(o) OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, ord) AS g FROM (
    SELECT *, CASE WHEN start_sec - max(end_sec) OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.05::DOUBLE THEN 0 ELSE 1 END AS o
    FROM rt_checked WHERE reason IS NULL)) GROUP BY video_id, g"""
VIEWS["rt_bounds"] = """SELECT video_id, b AS start_sec, lead(b) OVER (PARTITION BY video_id ORDER BY b) AS end_sec FROM (SELECT video_id, start_sec AS b FROM rt_merged UNION SELECT video_id, end_sec FROM rt_merged
    UNION SELECT video_id, 0::DOUBLE FROM media UNION SELECT video_id, duration_sec FROM media)"""
VIEWS["rt_pieces"] = """SELECT *, coalesce(sum((end_sec - start_sec) * factor) OVER (PARTITION BY video_id ORDER BY start_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_start FROM (
    SELECT b.video_id, b.start_sec, b.end_sec, coalesce(w.factor, 1) AS factor FROM rt_bounds b LEFT JOIN rt_merged w ON w.video_id = b.video_id AND w.start_sec = b.start_sec WHERE b.end_sec IS NOT NULL)"""
DEPENDS.update({"rt_checked": ["v_candidates", "media"], "rt_merged": ["rt_checked"], "rt_bounds": ["rt_merged", "media"], "rt_pieces": ["rt_bounds", "rt_merged"]})


def retime_checked(spark, d):
    w = v_candidates(spark, d).select("video_id", "ord", "start_sec", F.when(F.col("ord") % 37 == 0, F.col("start_sec")).otherwise(
        F.col("start_sec") + (F.col("end_sec") - F.col("start_sec")) / 4).alias("end_sec"), (F.lit(1.0) + (F.col("ord") % 4) * F.lit(0.2718281828459)).alias("factor"))
    return retime.check_windows(w, media(spark, d))


def retime_merged(spark, d):
    return retime.merge_windows(retime_checked(spark, d).filter(F.col("reason").isNull()))


def pieces(spark, d):
    return retime.partition_timeline(media(spark, d), stage(retime_merged(spark, d)))


@gate("retime_windows", oracle("rt_merged rt_checked", """SELECT video_id, start_sec, end_sec, factor, NULL AS reason FROM rt_merged
UNION ALL SELECT video_id, start_sec, end_sec, factor, reason FROM rt_checked WHERE reason IS NOT NULL"""))
def retime_windows(spark, d):
    good = retime_merged(spark, d).withColumn("reason", F.lit(None).cast("string"))
    bad = retime_checked(spark, d).filter(F.col("reason").isNotNull()).select("video_id", "start_sec", "end_sec", "factor", "reason")
    return good.unionByName(bad)


@gate("retime_partition", oracle("rt_pieces", f"SELECT video_id, {six('start_sec')} AS start_sec, {six('end_sec')} AS end_sec, factor, {six('new_start')} AS new_start FROM rt_pieces"))
def retime_partition(spark, d):
    return pieces(spark, d).withColumns({c: r6(c) for c in ("start_sec", "end_sec", "new_start")})


@gate("time_remap", oracle("rt_pieces v_series", f"""SELECT s.video_id, s.ord, {six('p.new_start + (s.t_sec - p.start_sec) * p.factor')} AS new_sec FROM v_series s ASOF JOIN rt_pieces p ON p.video_id = s.video_id AND s.t_sec >= p.start_sec"""))
def time_remap(spark, d):
    return retime.remap(v_series(spark, d).select("video_id", "ord", "t_sec"), stage(pieces(spark, d)), media(spark, d)).select(
        "video_id", "ord", r6("new_sec").alias("new_sec"))


@gate("retimed_duration", oracle("rt_pieces", f"SELECT video_id, max(end_sec) AS duration_sec, {six('sum((end_sec - start_sec) * factor)')} AS new_duration_sec FROM rt_pieces GROUP BY video_id"))
def retimed_duration(spark, d):
    return retime.retimed_duration(media(spark, d), retime_merged(spark, d)).withColumn("new_duration_sec", r6("new_duration_sec"))


