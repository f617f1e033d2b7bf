"""Queries over narration segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prompts
from ..operators import segments as ops
from ..params import ScriptParams
from ..session import stage
from .carriers import VIEWS, DEPENDS, oracle, v_segments
from ..functions.scoring import r6
from .registry import gate
from .scalars import LIMIT_SQL, certainty_sql, clean_sql, tone_sql, truncated_ctes, words_sql

CHUNK_SEC = 60.0

VIEWS["seg_media"] = "SELECT video_id, max(end_sec) AS duration_sec FROM v_segments GROUP BY video_id"
VIEWS["seg_chunks"] = """SELECT video_id, CAST(i AS INTEGER) AS chunk_index, i * 60::DOUBLE AS start_sec,
    least((i + 1) * 60::DOUBLE, duration_sec) AS end_sec
    FROM (SELECT *, unnest(range(CAST(ceil(duration_sec / 60) AS BIGINT))) AS i FROM seg_media)"""
VIEWS["seg_assigned"] = """SELECT s.*, coalesce(c.chunk_index, l.last_index) AS chunk_index, coalesce(c.start_sec, l.last_index * 60::DOUBLE) AS chunk_start
    FROM v_segments s LEFT JOIN seg_chunks c ON s.video_id = c.video_id AND (s.start_sec + s.end_sec) / 2 >= c.start_sec AND (s.start_sec + s.end_sec) / 2 < c.end_sec
    JOIN (SELECT video_id, max(chunk_index) AS last_index FROM seg_chunks GROUP BY 1) l ON l.video_id = s.video_id"""
# the sequential repair, one row at a time in every video at once
VIEWS["rep_rows"] = """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, id) AS rn FROM v_segments"""
VIEWS["rep_steps"] = """SELECT video_id, 0::BIGINT AS rn, 0::DOUBLE AS prev_end, 0::DOUBLE AS start_sec, 0::DOUBLE AS end_sec, false AS kept FROM rep_rows WHERE rn = 1
    UNION ALL
    SELECT video_id, rn, CASE WHEN e - s >= 8 THEN e ELSE prev_end END, s, e, e - s >= 8
    FROM (SELECT r.video_id, r.rn, p.prev_end, CASE WHEN r.start_sec < p.prev_end - 0.001::DOUBLE THEN p.prev_end ELSE r.start_sec END AS s,
            least(r.end_sec, 130) AS e FROM rep_steps p JOIN rep_rows r ON r.video_id = p.video_id AND r.rn = p.rn + 1)"""
VIEWS["repaired"] = """SELECT k.video_id, row_number() OVER (PARTITION BY k.video_id ORDER BY k.start_sec, k.rn) AS id, r.id AS src_id,
    k.start_sec, k.end_sec, r.text, r.tone, r.certainty FROM rep_steps k JOIN rep_rows r USING (video_id, rn) WHERE k.kept"""
DEPENDS.update({"seg_media": ["v_segments"], "seg_chunks": ["seg_media"], "seg_assigned": ["v_segments", "seg_chunks"],
                "rep_rows": ["v_segments"], "rep_steps": ["rep_rows"], "repaired": ["rep_steps", "rep_rows"]})

REPAIR = ScriptParams(min_segment_sec=8.0)
BUDGET = ScriptParams(words_per_sec=2.0)


def seg_media(spark, d):
    return v_segments(spark, d).groupBy("video_id").agg(F.max("end_sec").alias("duration_sec"))


def seg_chunks(spark, d):
    n = F.ceil(F.col("duration_sec") / CHUNK_SEC).cast("int")
    return seg_media(spark, d).select("video_id", "duration_sec", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index")).select(
        "video_id", "chunk_index", (F.col("chunk_index") * F.lit(CHUNK_SEC)).alias("start_sec"),
        F.least((F.col("chunk_index") + 1) * F.lit(CHUNK_SEC), F.col("duration_sec")).alias("end_sec"))


def assigned(spark, d):
    return ops.assign_to_chunks(v_segments(spark, d), seg_chunks(spark, d))


def repaired(spark, d):
    return ops.repair_timeline(v_segments(spark, d), high=F.lit(130.0), params=REPAIR)


@gate("coerce_segments", oracle("v_segments", f"""
SELECT video_id, CASE WHEN id % 4 = 0 THEN 0 ELSE id END AS id,
    CASE WHEN id % 5 <> 0 THEN start_sec END AS start_sec, CASE WHEN id % 3 = 0 THEN start_sec - 1 ELSE end_sec END AS end_sec,
    {clean_sql('text')} AS text, {tone_sql('tone')} AS tone, {certainty_sql('certainty')} AS certainty,
    CASE WHEN id % 5 = 0 OR (id % 3 = 0 AND start_sec < 1) THEN 'bad time' WHEN {clean_sql('text')} = '' THEN 'empty text' WHEN id % 3 = 0 THEN 'end before start' END AS reason
FROM v_segments"""))
def coerce_segments(spark, d):
    raw = F.to_json(F.struct(
        F.when(F.col("id") % 4 == 0, F.lit("x")).otherwise(F.col("id").cast("string")).alias("id"),
        F.when(F.col("id") % 5 == 0, F.lit("soon")).otherwise(F.col("start_sec").cast("string")).alias("start_time"),
        F.when(F.col("id") % 3 == 0, F.col("start_sec") - 1).otherwise(F.col("end_sec")).alias("end_time"),
        "text", F.col("tone").alias("tone"), "certainty"))
    return ops.coerce_segments(v_segments(spark, d).select("video_id", raw.alias("raw")))


@gate("clip_to_window", oracle("v_segments seg_chunks", """
SELECT s.video_id, s.id, c.chunk_index AS window_id, greatest(s.start_sec, c.start_sec) AS start_sec, least(s.end_sec, c.end_sec) AS end_sec
FROM v_segments s JOIN seg_chunks c ON s.video_id = c.video_id AND s.end_sec > c.start_sec AND s.start_sec < c.end_sec"""))
def clip_to_window(spark, d):
    w = seg_chunks(spark, d).withColumnsRenamed({"chunk_index": "window_id", "start_sec": "w_start", "end_sec": "w_end"})
    return ops.clip_to_windows(v_segments(spark, d), w).select("video_id", "id", "window_id", "start_sec", "end_sec")


@gate("repair_timeline", oracle("v_segments repaired", """
SELECT video_id, id, src_id, start_sec, end_sec, text, tone, certainty, NULL AS reason FROM repaired
UNION ALL SELECT video_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'empty script' FROM (SELECT video_id FROM v_segments EXCEPT SELECT video_id FROM repaired)"""))
def repair_timeline(spark, d):
    return ops.repair_with_errors(v_segments(spark, d), high=F.lit(130.0), params=REPAIR)


@gate("word_budget", oracle("v_segments", f"""
SELECT video_id, id, CAST({words_sql('text')} AS INTEGER) AS words, {LIMIT_SQL.format(wps='2.0')} AS max_words,
    {words_sql('text')} > {LIMIT_SQL.format(wps='2.0')} AS over_budget, round_even(({words_sql('text')} / (end_sec - start_sec)) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS words_per_sec FROM v_segments"""))
def word_budget(spark, d):
    return ops.word_budget(v_segments(spark, d), BUDGET).select(
        "video_id", "id", "words", "max_words", "over_budget", r6("words_per_sec").alias("words_per_sec"))


# three rewrite rows per segment: a third of the text, the first two words (kept only for even ids), and one with an unusable id
def rewrites(spark, d):
    from ..functions.text import tokens
    toks = tokens(F.col("text"))
    variants = F.array(
        F.struct(F.lit(1).alias("ord"), F.col("id").cast("string").alias("id"), F.array_join(F.slice(toks, 1, 9), " ").alias("text")),
        F.struct(F.lit(2).alias("ord"), F.col("id").cast("string").alias("id"),
                 F.when(F.col("id") % 2 == 0, F.array_join(F.slice(toks, 3, 5), " ")).otherwise("**").alias("text")),
        F.struct(F.lit(3).alias("ord"), F.lit("n/a").alias("id"), F.lit("word").alias("text")),
        F.struct(F.lit(4).alias("ord"), F.col("id").cast("string").alias("id"), F.array_join(F.slice(toks, 6, 5), " ").alias("text")))
    return v_segments(spark, d).select("video_id", F.inline(variants))


def marks_sql(t):
    from ..functions.text import VI_MARKED
    letters = f"length(regexp_replace(lower({t}), '[^\\p{{L}}]+', '', 'g'))"
    hits = f"length(regexp_replace(lower({t}), '[^{VI_MARKED}]+', '', 'g'))"
    return f"coalesce({letters} >= 6 AND {hits} / nullif({letters}, 0) < 0.08::DOUBLE, false)"


REWRITE_CTES = [
    "toks AS (SELECT *, list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM v_segments)",
    f"""rw AS (SELECT video_id, id, 1 AS ord, {clean_sql("array_to_string(t[1:9], ' ')")} AS body FROM toks
        UNION ALL SELECT video_id, id, 2, {clean_sql("array_to_string(t[3:7], ' ')")} FROM toks WHERE id % 2 = 0
        UNION ALL SELECT video_id, id, 4, {clean_sql("array_to_string(t[6:10], ' ')")} FROM toks)""",
    f"usable AS (SELECT *, {words_sql('body')} AS words FROM rw WHERE body <> '' AND NOT {marks_sql('body')})",
    f"""rw_steps AS (SELECT video_id, id, 0 AS ord, text AS body, {words_sql('text')} AS words FROM v_segments
        UNION ALL SELECT p.video_id, p.id, p.ord + 1, CASE WHEN u.words < p.words THEN u.body ELSE p.body END, least(p.words, coalesce(u.words, p.words))
        FROM rw_steps p LEFT JOIN usable u ON u.video_id = p.video_id AND u.id = p.id AND u.ord = p.ord + 1 WHERE p.ord < 4)""",
    "rewritten AS (SELECT p.video_id, p.id, s.start_sec, s.end_sec, p.body AS text, p.body <> s.text AS rewritten FROM rw_steps p JOIN v_segments s USING (video_id, id) WHERE p.ord = 4)",
]


@gate("apply_rewrites", oracle("v_segments", "SELECT video_id, id, text, rewritten FROM rewritten", REWRITE_CTES))
def apply_rewrites(spark, d):
    return ops.apply_rewrites(v_segments(spark, d), rewrites(spark, d)).select("video_id", "id", "text", "rewritten")


@gate("enforce_budget", oracle("v_segments", f"""
SELECT s.video_id, s.id, {words_sql('s.text')} > lim AS truncated, CASE WHEN {words_sql('s.text')} > lim THEN short_text ELSE s.text END AS text
FROM lim s JOIN truncated USING (video_id, id)""", [*REWRITE_CTES, f"lim AS (SELECT *, {LIMIT_SQL.format(wps='0.5')} AS lim FROM rewritten)", *truncated_ctes("lim")]))
def enforce_budget(spark, d):
    done = ops.apply_rewrites(v_segments(spark, d), rewrites(spark, d))
    return ops.enforce_budget(done, ScriptParams(words_per_sec=0.5)).select("video_id", "id", "truncated", "text")


@gate("coverage", oracle("v_segments seg_media", """
SELECT video_id, sum(end_sec - start_sec) AS covered_sec, count(*) AS segments, any_value(duration_sec) AS duration_sec,
    round_even((sum(end_sec - start_sec) / any_value(duration_sec)) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS share FROM v_segments JOIN seg_media USING (video_id) GROUP BY video_id"""))
def coverage(spark, d):
    return ops.coverage(v_segments(spark, d), seg_media(spark, d)).withColumn("share", r6("share"))


@gate("certainty_audit", oracle("v_segments", f"""
SELECT video_id, count(*) FILTER (c = 'observed_fact') AS observed_fact, count(*) FILTER (c = 'safe_inference') AS safe_inference,
    count(*) FILTER (c = 'creative_framing') AS creative_framing, count(*) FILTER (c = 'user_provided_fact') AS user_provided_fact,
    count(*) AS segments, count(*) FILTER (c = 'creative_framing') / count(*) > 0.2::DOUBLE AS flagged
FROM (SELECT *, {certainty_sql('certainty')} AS c FROM v_segments) GROUP BY video_id"""))
def certainty_audit(spark, d):
    from ..functions.text import normalize_certainty
    return ops.certainty_audit(v_segments(spark, d).withColumn("certainty", normalize_certainty(F.col("certainty"))))


@gate("assign_to_chunks", oracle("seg_assigned", "SELECT video_id, id, chunk_index, chunk_start FROM seg_assigned"))
def assign_to_chunks(spark, d):
    return assigned(spark, d).select("video_id", "id", "chunk_index", "chunk_start")


@gate("empty_chunks", oracle("seg_assigned seg_chunks", """
SELECT video_id, chunk_index, start_sec, end_sec FROM seg_chunks c WHERE NOT EXISTS (SELECT 1 FROM seg_assigned a WHERE a.certainty = 'creative_framing'
    AND a.video_id = c.video_id AND a.chunk_index = c.chunk_index)"""))
def empty_chunks(spark, d):
    """Chunks in which no line is labelled as creative."""
    creative = ops.assign_to_chunks(v_segments(spark, d).filter(F.col("certainty") == "creative_framing"), seg_chunks(spark, d))
    return ops.empty_chunks(creative, seg_chunks(spark, d))


@gate("shift_time", oracle("seg_assigned", "SELECT video_id, id, start_sec - chunk_start AS start_sec, end_sec - chunk_start AS end_sec FROM seg_assigned"))
def shift_time(spark, d):
    return ops.shift_time(assigned(spark, d), -F.col("chunk_start")).select("video_id", "id", "start_sec", "end_sec")


@gate("story_hook", oracle("seg_assigned seg_chunks", """
SELECT c.video_id, c.chunk_index, CASE WHEN length(t) > 280 THEN substr(t, 1, 280) || '…' ELSE t END AS hook FROM seg_chunks c LEFT JOIN (
    SELECT video_id, string_agg(text, ' ' ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, id) AS rn
        FROM seg_assigned WHERE chunk_index = 0) WHERE rn <= 2 GROUP BY video_id) h USING (video_id) WHERE c.chunk_index > 0"""))
def story_hook(spark, d):
    return ops.story_hook(assigned(spark, d), seg_chunks(spark, d))


@gate("previous_context", oracle("v_segments", """
SELECT b.video_id, b.batch, coalesce((SELECT string_agg(text, chr(10) ORDER BY rn) FROM n WHERE n.video_id = b.video_id AND n.rn <= b.batch * 2 AND n.rn > b.batch * 2 - 3), '') AS context
FROM (SELECT DISTINCT video_id, (rn - 1) // 2 AS batch FROM n) b""",
      ["n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, id) AS rn FROM v_segments)"]))
def previous_context(spark, d):
    return ops.previous_context(v_segments(spark, d), per_batch=2)


@gate("prompt_rewrite", oracle("v_segments", f"""
SELECT video_id, id, max_words, 'Shorten to at most ' || max_words || ' words, same language and meaning.' || chr(10) || 'Line ' || id || ': ' || text || chr(10) || 'Answer with a JSON array: id, text.' AS prompt
FROM (SELECT *, {LIMIT_SQL.format(wps='2.0')} AS max_words FROM v_segments) WHERE {words_sql('text')} > max_words"""))
def prompt_rewrite(spark, d):
    return prompts.rewrite_requests(ops.word_budget(v_segments(spark, d), BUDGET))


@gate("prompt_story", oracle("v_segments seg_assigned", """
SELECT b.video_id, b.batch, CASE WHEN h.hook <> '' THEN 'The story opened with: ' || h.hook || chr(10) ELSE '' END || CASE WHEN b.context <> '' THEN 'Before:' || chr(10) || b.context || chr(10) ELSE '' END
  || 'Describe batch ' || b.batch || '.' || chr(10) || 'State only what is seen; mark the rest as an inference or as framing.' AS prompt
FROM (SELECT d.video_id, d.batch, coalesce((SELECT string_agg(text, chr(10) ORDER BY rn) FROM n WHERE n.video_id = d.video_id AND n.rn <= d.batch * 2 AND n.rn > d.batch * 2 - 3), '') AS context
      FROM (SELECT DISTINCT video_id, (rn - 1) // 2 AS batch FROM n) d) b
LEFT JOIN (SELECT video_id, CASE WHEN length(t) > 280 THEN substr(t, 1, 280) || '…' ELSE t END AS hook FROM (SELECT video_id, string_agg(text, ' ' ORDER BY rn) AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, id) AS rn FROM seg_assigned WHERE chunk_index = 0) WHERE rn <= 2 GROUP BY video_id)) h USING (video_id)""",
      ["n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, id) AS rn FROM v_segments)"]))
def prompt_story(spark, d):
    """Batch prompts with the lines before each batch and the hook of the story."""
    context = stage(ops.previous_context(v_segments(spark, d), per_batch=2))
    base = context.select("video_id", "batch", F.concat(F.lit("Describe batch "), F.col("batch").cast("string"), F.lit(".")).alias("prompt"))
    every = v_segments(spark, d).select("video_id").distinct().select("video_id", F.lit(1).alias("chunk_index"))
    return prompts.with_story(base, context, ops.story_hook(assigned(spark, d), every))
