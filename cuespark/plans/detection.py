"""Queries over detection, planning and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning, prompts, signal
from ..params import ChunkParams, SilenceParams, WindowParams
from ..session import stage
from ..sources.media import media_catalog
from .carriers import DEPENDS, VIEWS, oracle, v_frames, v_media_json, v_segments, v_series
from ..functions.scoring import r6
from .registry import gate
from .scalars import clock_sql

QUIET = SilenceParams(threshold=50.0, min_sec=6.0)
WINDOWS = WindowParams(scene_threshold=0.39)


def media(spark, d):
    return v_series(spark, d).groupBy("video_id").agg((F.max("t_sec") + 1).alias("duration_sec"))


def silences(spark, d):
    return stage(signal.silence_runs(v_series(spark, d), QUIET))


def marks(spark, d):
    """Peaks of the level series, taken as scene cuts."""
    return v_series(spark, d).filter(F.col("level") >= 150).select("video_id", "t_sec")


def chunks(spark, d):
    return stage(planning.plan_chunks(media(spark, d), planning.cut_points(silences(spark, d))))


def catalog(spark, d):
    return media_catalog(v_media_json(spark, d)).filter(F.col("reason").isNull()).select("video_id", "duration_sec")


def cuts(spark, d):
    return stage(signal.scene_cuts(v_frames(spark, d), WINDOWS))


def frame_media(spark, d):
    return v_frames(spark, d).groupBy("video_id").agg((F.max("t_sec") + 5).alias("duration_sec"))


VIEWS["catalog"] = """SELECT p_partkey AS video_id, CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice ELSE 7.25::DOUBLE END AS duration_sec
    FROM part WHERE p_partkey % 17 <> 0"""
VIEWS["runs"] = """SELECT video_id, quiet, min(t_sec) AS start_sec, max(t_sec) AS end_sec FROM (
      SELECT *, sum(chg) OVER (PARTITION BY video_id ORDER BY t_sec, ord) AS run FROM (SELECT *, level < 50 AS quiet,
        CASE WHEN (level < 50) IS DISTINCT FROM lag(level < 50) OVER (PARTITION BY video_id ORDER BY t_sec, ord) THEN 1 ELSE 0 END AS chg FROM v_series))
    GROUP BY video_id, run, quiet"""
VIEWS["voice"] = """SELECT video_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM (
      SELECT *, sum(o) OVER (PARTITION BY video_id ORDER BY start_sec) AS g FROM (SELECT *, CASE WHEN start_sec - lag(end_sec) OVER (PARTITION BY video_id ORDER BY start_sec) < 6
        THEN 0 ELSE 1 END AS o FROM runs WHERE NOT quiet)) GROUP BY video_id, g"""
VIEWS["marks"] = "SELECT video_id, t_sec FROM v_series WHERE level >= 150"
VIEWS["distances"] = """SELECT video_id, idx, t_sec, sqrt(greatest(0, 1 - list_sum(list_transform(range(1, 65), lambda i: sqrt(prev[i] * hist[i]))) / sqrt(list_sum(prev) * list_sum(hist)))) AS distance
    FROM (SELECT *, lag(hist) OVER (PARTITION BY video_id ORDER BY t_sec, idx) AS prev FROM v_frames) WHERE prev IS NOT NULL"""
VIEWS["jumps"] = "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t_sec, idx) AS rn FROM distances WHERE distance > 0.39"
VIEWS["cut_steps"] = """SELECT video_id, rn, t_sec, t_sec AS last_cut, true AS kept FROM jumps WHERE rn = 1
    UNION ALL SELECT j.video_id, j.rn, j.t_sec, CASE WHEN j.t_sec - c.last_cut >= 1.5 THEN j.t_sec ELSE c.last_cut END, j.t_sec - c.last_cut >= 1.5
    FROM cut_steps c JOIN jumps j ON j.video_id = c.video_id AND j.rn = c.rn + 1"""
VIEWS["cuts"] = "SELECT video_id, round_even(t_sec * 1000, 0) / 1000::DOUBLE AS t_sec FROM cut_steps WHERE kept"
VIEWS["frame_media"] = "SELECT video_id, max(t_sec) + 5 AS duration_sec FROM v_frames GROUP BY video_id"
DEPENDS.update({"runs": ["v_series"], "voice": ["runs"], "marks": ["v_series"], "distances": ["v_frames"], "jumps": ["distances"],
                "cut_steps": ["jumps"], "cuts": ["cut_steps"], "frame_media": ["v_frames"]})


@gate("silence_runs", oracle("silences", "SELECT * FROM silences"))
def silence_runs(spark, d):
    return signal.silence_runs(v_series(spark, d), QUIET)


@gate("voice_ranges", oracle("voice", "SELECT * FROM voice"))
def voice_ranges(spark, d):
    return signal.voice_ranges(v_series(spark, d), 50.0, 6.0)


@gate("trim_bounds", oracle("v_series", """
SELECT video_id, CASE WHEN ok THEN greatest(t0, a - 0.06::DOUBLE) ELSE t0 END AS start_sec, CASE WHEN ok THEN least(t1, b + 0.06::DOUBLE) ELSE t1 END AS end_sec, ok AS trimmed
FROM (SELECT *, coalesce(least(t1, b + 0.06::DOUBLE) - greatest(t0, a - 0.06::DOUBLE) >= 0.1::DOUBLE, false) AS ok FROM (
    SELECT video_id, min(t_sec) AS t0, max(t_sec) AS t1, min(t_sec) FILTER (level >= 120) AS a, max(t_sec) FILTER (level >= 120) AS b FROM v_series GROUP BY video_id))"""))
def trim_bounds(spark, d):
    return signal.trim_bounds(v_series(spark, d), 120.0)


@gate("histogram_distance", oracle("distances", "SELECT video_id, idx, t_sec, round_even((distance) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS distance FROM distances"))
def histogram_distance(spark, d):
    return signal.frame_distances(v_frames(spark, d)).withColumn("distance", r6("distance"))


@gate("scene_cuts", oracle("cuts", "SELECT * FROM cuts"))
def scene_cuts(spark, d):
    return signal.scene_cuts(v_frames(spark, d), WINDOWS)


@gate("pick_cut", oracle("media silences marks", """
SELECT video_id, target_sec, coalesce(b.t, target_sec) AS cut_sec, CASE WHEN b IS NULL THEN 'hard' WHEN b.grade = 0 THEN 'silence' ELSE 'scene' END AS cut_reason
FROM (SELECT t.video_id, t.target_sec, min({'grade': c.grade, 'd': abs(c.t_sec - t.target_sec), 't': c.t_sec}) FILTER (c.t_sec IS NOT NULL) AS b FROM targets t LEFT JOIN cands c ON c.video_id = t.video_id
    AND abs(c.t_sec - t.target_sec) <= 8 AND c.t_sec > t.target_sec - 180 AND c.t_sec < t.duration_sec GROUP BY ALL)""", [
    "targets AS (SELECT video_id, duration_sec, unnest([60, 120, 300, 480, 600])::DOUBLE AS target_sec FROM media)",
    "cands AS (SELECT video_id, (start_sec + end_sec) / 2 AS t_sec, 0 AS grade FROM silences UNION ALL SELECT video_id, t_sec, 1 FROM marks)"]))
def pick_cut(spark, d):
    targets = media(spark, d).withColumn("target_sec", F.explode(F.array(*[F.lit(float(x)) for x in (60, 120, 300, 480, 600)])))
    targets = targets.withColumn("min_start", F.col("target_sec") - 180)
    return planning.pick_cuts(targets, planning.cut_points(silences(spark, d), marks(spark, d)), ChunkParams(tolerance_sec=8.0))


@gate("plan_chunks", oracle("chunks", "SELECT * FROM chunks"))
def plan_chunks(spark, d):
    return planning.plan_chunks(media(spark, d), planning.cut_points(silences(spark, d)))


@gate("equal_windows", oracle("catalog", """
SELECT video_id, CAST(i AS INTEGER) AS window_index, i * step AS w_start, (i + 1) * step AS w_end
FROM (SELECT video_id, duration_sec / n AS step, unnest(range(n)) AS i FROM (SELECT *, greatest(1, CAST(round_even(duration_sec / 30, 0) AS BIGINT)) AS n FROM catalog))"""))
def equal_windows(spark, d):
    return planning.equal_windows(catalog(spark, d), 30.0)


def scene_window_sql(media_sql: str, cuts_sql: str, keys: str, cap: int) -> list[str]:
    """Windows by the list route: merge scenes one after the other, then the first one, then split and cap."""
    return [
        f"wm AS ({media_sql})", f"wc AS ({cuts_sql})",
        f"wb AS (SELECT {keys}, duration_sec, list_sort(list_distinct(list_concat([0::DOUBLE], coalesce(cs, []::DOUBLE[])))) AS b FROM wm LEFT JOIN "
        f"(SELECT {keys}, list(t_sec) AS cs FROM wm JOIN wc USING ({keys}) WHERE t_sec > 0 AND t_sec < duration_sec GROUP BY {keys}) q USING ({keys}))",
        f"ws AS (SELECT {keys}, duration_sec, i, len(b) AS nb, b[i] AS s, coalesce(b[i + 1], duration_sec) AS e FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM wb))",
        f"wg AS (SELECT *, sum(CASE WHEN i = 1 OR e - s >= 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY i) AS g FROM ws)",
        f"wh AS (SELECT {keys}, duration_sec, nb, g, min(s) AS s, max(e) AS e FROM wg GROUP BY {keys}, duration_sec, nb, g)",
        f"wi AS (SELECT *, first_value(e - s) OVER (PARTITION BY {keys} ORDER BY g) < 1.5 AND count(*) OVER (PARTITION BY {keys}) > 1 AS drop_first, "
        f"first_value(s) OVER (PARTITION BY {keys} ORDER BY g) AS s0 FROM wh)",
        f"wj AS (SELECT {keys}, duration_sec, nb, CASE WHEN drop_first AND g = 2 THEN s0 ELSE s END AS s, e FROM wi WHERE NOT (drop_first AND g = 1))",
        "wk AS (SELECT *, CASE WHEN nb = 1 THEN greatest(1, CAST(round_even(duration_sec / 2.5, 0) AS BIGINT)) WHEN e - s > 6 THEN greatest(2, CAST(round_even((e - s) / 2.5, 0) AS BIGINT)) ELSE 1 END AS n FROM wj)",
        f"wl AS (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS total FROM wk)",
        f"windows AS (SELECT {keys}, s + i * ((e - s) / n) AS w_start, s + (i + 1) * ((e - s) / n) AS w_end FROM (SELECT *, unnest(range(n)) AS i FROM wl WHERE total <= {cap}) "
        f"UNION ALL SELECT {keys}, i * (duration_sec / {cap}), (i + 1) * (duration_sec / {cap}) FROM (SELECT *, unnest(range({cap})) AS i FROM (SELECT DISTINCT {keys}, duration_sec FROM wl WHERE total > {cap})))",
    ]


ROUND_W = "round_even((w_start) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS w_start, round_even((w_end) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS w_end"


@gate("scene_windows", oracle("frame_media cuts", f"SELECT video_id, {ROUND_W} FROM windows",
      scene_window_sql("SELECT * FROM frame_media", "SELECT * FROM cuts", "video_id", 400)))
def scene_windows(spark, d):
    return rounded(planning.scene_windows(frame_media(spark, d), cuts(spark, d), WINDOWS))


def rounded(df):
    return df.withColumns({"w_start": r6("w_start"), "w_end": r6("w_end")})


@gate("scene_windows_capped", oracle("frame_media cuts", f"SELECT video_id, {ROUND_W} FROM windows",
      scene_window_sql("SELECT * FROM frame_media", "SELECT * FROM cuts", "video_id", 20)))
def scene_windows_capped(spark, d):
    return rounded(planning.scene_windows(frame_media(spark, d), cuts(spark, d), WindowParams(max_frames=20)))


@gate("frame_times", oracle("catalog", """
SELECT video_id, w_start, round_even((w_start + (j + 0.5::DOUBLE) * (w_end - w_start) / k) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS t_sec FROM (SELECT *, unnest(range(k)) AS j FROM (
  SELECT video_id, i * step AS w_start, (i + 1) * step AS w_end, least(2, greatest(1, CAST(round_even(((i + 1) * step - i * step) / 2.5, 0) AS BIGINT))) AS k
  FROM (SELECT video_id, duration_sec / n AS step, unnest(range(n)) AS i FROM (SELECT *, greatest(1, CAST(round_even(duration_sec / 60, 0) AS BIGINT)) AS n FROM catalog))))"""))
def frame_times(spark, d):
    w = planning.equal_windows(catalog(spark, d), 60.0)
    return planning.frame_times(w, WINDOWS).select("video_id", "w_start", r6("t_sec").alias("t_sec"))


FRAME_CHUNKS = """SELECT video_id, CAST(i AS INTEGER) AS chunk_index, i * 20::DOUBLE AS start_sec, least((i + 1) * 20::DOUBLE, duration_sec) AS end_sec
    FROM (SELECT *, unnest(range(CAST(ceil(duration_sec / 20) AS BIGINT))) AS i FROM frame_media)"""


@gate("windows_in_range", oracle("frame_media cuts", "SELECT video_id, chunk_index, round_even((w_start + start_sec) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS w_start, round_even((w_end + start_sec) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS w_end FROM windows JOIN fc USING (video_id, chunk_index)",
      [f"fc AS ({FRAME_CHUNKS})", *scene_window_sql("SELECT video_id, chunk_index, end_sec - start_sec AS duration_sec FROM fc",
       "SELECT video_id, chunk_index, t_sec - start_sec AS t_sec FROM cuts JOIN fc USING (video_id) WHERE t_sec > start_sec AND t_sec < end_sec", "video_id, chunk_index", 400)]))
def windows_in_range(spark, d):
    n = F.ceil(F.col("duration_sec") / 20.0).cast("int")
    fc = frame_media(spark, d).select("video_id", "duration_sec", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index")).select(
        "video_id", "chunk_index", (F.col("chunk_index") * 20.0).alias("start_sec"), F.least((F.col("chunk_index") + 1) * 20.0, F.col("duration_sec")).alias("end_sec"))
    return rounded(planning.windows_in_chunks(fc, cuts(spark, d), WINDOWS))


@gate("sampling_grid", oracle("v_series media", """
SELECT g.video_id, g.grid_index, round_even((grid_sec) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS grid_sec, round_even((w_start) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS w_start, round_even((w_end) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS w_end, b.ord AS sample_ord, b.t_sec AS sample_sec FROM grid g LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY video_id, cell ORDER BY d, t_sec, ord) AS r FROM (SELECT s.video_id, s.ord, s.t_sec, c.cell, abs(s.t_sec - (c.cell + 0.5::DOUBLE) * m.step) AS d
    FROM v_series s JOIN gm m USING (video_id), LATERAL (SELECT least(CAST(floor(s.t_sec / m.step) AS BIGINT), m.n - 1) AS cell) c)) b ON b.video_id = g.video_id AND b.cell = g.grid_index AND b.r = 1""", [
    "gm AS (SELECT *, duration_sec / n AS step FROM (SELECT *, greatest(1, CAST(round_even(duration_sec / 6, 0) AS BIGINT)) AS n FROM media))",
    """grid AS (SELECT video_id, CAST(i AS INTEGER) AS grid_index, (i + 0.5::DOUBLE) * step AS grid_sec, greatest(0, (i + 0.5::DOUBLE) * step - step / 2) AS w_start,
        least(duration_sec, (i + 0.5::DOUBLE) * step + step / 2) AS w_end FROM (SELECT *, unnest(range(n)) AS i FROM gm))"""]))
def sampling_grid(spark, d):
    return rounded(planning.nearest_samples(v_series(spark, d), media(spark, d), 6.0)).withColumn("grid_sec", r6("grid_sec"))


@gate("batch_fixed", oracle("v_series", """
SELECT video_id, ord, row_number() OVER (PARTITION BY video_id ORDER BY t_sec, ord) AS row_no, (row_number() OVER (PARTITION BY video_id ORDER BY t_sec, ord) - 1) // 8 AS batch FROM v_series"""))
def batch_fixed(spark, d):
    return planning.batch_fixed(v_series(spark, d), 8).select("video_id", "ord", "row_no", "batch")


@gate("batch_by_scene", oracle("frame_media cuts", """
SELECT video_id, round_even((min(w_start)) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS start_sec, round_even((max(w_end)) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS end_sec, CAST(sum(n) AS BIGINT) AS samples, CAST(count(*) AS INTEGER) AS groups FROM bs GROUP BY video_id, batch""", [
    *scene_window_sql("SELECT * FROM frame_media", "SELECT * FROM cuts", "video_id", 400),
    "fs AS (SELECT video_id, w_start, w_end, unnest(range(least(3, greatest(1, CAST(round_even((w_end - w_start) / 1, 0) AS BIGINT))))) AS j FROM windows)",
    "gs AS (SELECT video_id, w_start, w_end, j // 2 AS piece, count(*) AS n FROM fs GROUP BY ALL)",
    "gr AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY w_start, piece) AS rn FROM gs)",
    """bs AS (SELECT video_id, rn, w_start, w_end, n, 0 AS batch, w_start AS s0 FROM gr WHERE rn = 1
       UNION ALL SELECT g.video_id, g.rn, g.w_start, g.w_end, g.n, CASE WHEN b.w_end - b.s0 >= 8 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.w_end - b.s0 >= 8 THEN g.w_start ELSE b.s0 END
       FROM bs b JOIN gr g ON g.video_id = b.video_id AND g.rn = b.rn + 1)"""]))
def batch_by_scene(spark, d):
    w = planning.scene_windows(frame_media(spark, d), cuts(spark, d), WINDOWS)
    samples = planning.frame_times(stage(w), WindowParams(interval_sec=1.0, max_frames_per_window=3))
    out = planning.batch_by_scene(samples, 8.0, 2)
    return out.withColumns({"start_sec": r6("start_sec"), "end_sec": r6("end_sec")})


@gate("sparse_pick", oracle("v_series", """
SELECT video_id, ord, t_sec, rn AS row_no, n FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t_sec, ord) AS rn, count(*) OVER (PARTITION BY video_id) AS n FROM v_series)
WHERE (rn - 1) % greatest(1, n // least(n, 10)) = 0 AND (rn - 1) // greatest(1, n // least(n, 10)) < 10"""))
def sparse_pick(spark, d):
    return planning.sparse_pick(v_series(spark, d)).select("video_id", "ord", "t_sec", "row_no", "n")


@gate("prompt_table", oracle("v_series", f"""
SELECT video_id, batch, count(*) AS n, string_agg('Image ' || k || ': ' || clock, chr(10) ORDER BY rn) || chr(10) || 'Range: ' || min(clock) || ' - ' || max(clock) || chr(10) || 'At most '
  || greatest(1, CAST(floor((max(t_sec) - min(t_sec)) * 3) AS INTEGER)) || ' words.' || chr(10) || 'Creativity: low.' || chr(10) || 'Style: natural.' || chr(10) || 'Purpose: documentary.' || chr(10)
  || CASE WHEN batch = 0 THEN 'Open with a hook.' ELSE 'Continue the story.' END AS prompt
FROM (SELECT *, (rn - 1) // 8 AS batch, (rn - 1) % 8 + 1 AS k, {clock_sql('t_sec')} AS clock FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t_sec, ord) AS rn FROM v_series)) GROUP BY video_id, batch"""))
def prompt_table(spark, d):
    return planning.prompt_table(v_series(spark, d), 8, 3.0, 0.3, style="natural", purpose="documentary")


# ---------------------------------------------------------------- requests beyond the batch prompts
LIST_SQL = "string_agg('Image ' || k || ': ' || clock, chr(10) ORDER BY rn)"
NUMBERED_SQL = f"SELECT *, {clock_sql('t_sec')} AS clock FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t_sec, ord) AS rn, count(*) OVER (PARTITION BY video_id) AS n FROM v_series)"


@gate("prompt_outline", oracle("v_series", f"""
SELECT video_id, count(*) AS n, 'Outline the whole video in order.' || chr(10) || {LIST_SQL} || chr(10) || 'Length: ' || max(clock) || chr(10) || 'Answer with a JSON array of parts: start_time, end_time, summary.' AS prompt
FROM (SELECT *, (rn - 1) // step + 1 AS k FROM (SELECT *, greatest(1, n // least(n, 10)) AS step FROM ({NUMBERED_SQL})) WHERE (rn - 1) % step = 0 AND (rn - 1) // step < 10) GROUP BY video_id"""))
def prompt_outline(spark, d):
    return prompts.outline_requests(v_series(spark, d))


@gate("prompt_highlight", oracle("v_series", f"""
SELECT video_id, batch, count(*) AS n, 'Find the moments worth keeping.' || chr(10) || {LIST_SQL} || chr(10) || 'Range: ' || min(clock) || ' - ' || max(clock) || chr(10)
  || 'Answer with a JSON array: start_time, end_time, score from 1 to 10.' AS prompt FROM (SELECT *, (rn - 1) // 8 AS batch, (rn - 1) % 8 + 1 AS k FROM ({NUMBERED_SQL})) GROUP BY video_id, batch"""))
def prompt_highlight(spark, d):
    return prompts.highlight_requests(v_series(spark, d), 8)


CONTINUOUS_SQL = f"""SELECT video_id, batch, count(*) AS n, min(t_sec) AS t0, max(t_sec) AS t1,
    'Write one flowing paragraph over all images, with full punctuation.' || chr(10) || {LIST_SQL} || chr(10) || 'Range: ' || min(clock) || ' - ' || max(clock) || chr(10)
    || 'At most ' || greatest(1, CAST(floor((max(t_sec) - min(t_sec)) * 3) AS INTEGER)) || ' words.' || chr(10)
    || 'Answer with a JSON array of one element that has just this range: start_time, end_time, text, tone, certainty.' AS prompt
  FROM (SELECT *, (rn - 1) // 8 AS batch, (rn - 1) % 8 + 1 AS k FROM ({NUMBERED_SQL})) GROUP BY video_id, batch"""


@gate("prompt_continuous", oracle("v_series v_segments", f"""
SELECT p.video_id, p.batch, n, prompt || coalesce(chr(10) || 'Outline here:' || chr(10) || parts, '') AS prompt
FROM ({CONTINUOUS_SQL}) p LEFT JOIN (
  SELECT p.video_id, p.batch, string_agg({clock_sql('start_sec')} || ' - ' || {clock_sql('end_sec')} || ': ' || text, chr(10) ORDER BY start_sec, end_sec, text) AS parts
  FROM ({CONTINUOUS_SQL}) p JOIN v_segments s ON s.video_id = p.video_id AND s.start_sec < p.t1 AND s.end_sec > p.t0 WHERE trim(text, ' ') <> '' GROUP BY p.video_id, p.batch
) o ON o.video_id = p.video_id AND o.batch = p.batch"""))
def prompt_continuous(spark, d):
    """One paragraph per batch; the segments of the video with the same id stand for its outline."""
    outline = v_segments(spark, d).withColumnRenamed("text", "summary")
    asked = stage(prompts.continuous_requests(v_series(spark, d), 8, 3.0))
    return prompts.with_outline(asked, outline).drop("t0", "t1")


@gate("prompt_link", oracle("chunks", f"""
SELECT video_id, chunk_index, 'Watch https://video.example/' || video_id || chr(10) || 'Narrate all of ' || {clock_sql('start_sec')} || ' - ' || {clock_sql('end_sec')} || chr(10)
  || 'At most ' || greatest(1, CAST(floor((end_sec - start_sec) * 3) AS INTEGER)) || ' words.' || chr(10) || CASE WHEN chunk_index = 0 THEN 'Open with a hook.' ELSE 'Continue the story.' END || chr(10)
  || 'Answer with a JSON array: start_time, end_time, text, tone, certainty.' AS prompt FROM chunks"""))
def prompt_link(spark, d):
    url = F.concat(F.lit("https://video.example/"), F.col("video_id").cast("string"))
    return prompts.link_requests(chunks(spark, d).withColumn("url", url), 3.0)
