"""Queries over mixing, subtitles and the stage ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import r6
from ..operators import ledger, mix, signal, subtitles
from ..operators.scan import Axis, RowNumber, scan
from ..params import MixParams
from ..session import new_folder, stage
from .carriers import DEPENDS, VIEWS, WS_SQL, oracle, table, v_candidates, v_frames, v_ledger, v_segments, v_series, v_words
from .narration import CHUNKED, narration_placed, six
from .registry import gate
from .scalars import FIT_SQL, WRAP_SQL, clock_sql, tokens_sql
from .script import seg_chunks

# ---------------------------------------------------------------- mixing
VIEWS["planned"] = "SELECT video_id, start_sec, end_sec FROM v_segments"
VIEWS["duck"] = """SELECT video_id, min(s) AS start_ms, max(e) AS end_ms FROM (SELECT *, sum(o) OVER (PARTITION BY video_id ORDER BY s, e) AS g FROM (
    SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 300 THEN 0 ELSE 1 END AS o FROM (
      SELECT video_id, CAST(round_even(start_sec * 1000, 0) AS BIGINT) AS s, CAST(round_even(end_sec * 1000, 0) AS BIGINT) AS e FROM voice
      UNION SELECT video_id, CAST(round_even(start_sec * 1000, 0) AS BIGINT), CAST(round_even(end_sec * 1000, 0) AS BIGINT) FROM planned))) GROUP BY video_id, g"""
VIEWS["gains"] = """SELECT s.video_id, s.ord, s.t_sec, s.level, coalesce(min(CASE WHEN s.t_sec * 1000 >= r.start_ms AND s.t_sec * 1000 < r.end_ms THEN 0.15::DOUBLE
      WHEN s.t_sec * 1000 < r.start_ms THEN 1 + (0.15::DOUBLE - 1) * (s.t_sec * 1000 - (r.start_ms - 2000)) / 2000 ELSE 0.15::DOUBLE - (0.15::DOUBLE - 1) * (s.t_sec * 1000 - r.end_ms) / 2000 END), 1) AS gain
    FROM v_series s LEFT JOIN duck r ON r.video_id = s.video_id AND s.t_sec * 1000 >= r.start_ms - 2000 AND s.t_sec * 1000 < r.end_ms + 2000 GROUP BY ALL"""
DEPENDS.update({"planned": ["v_segments"], "duck": ["voice", "planned"], "gains": ["v_series", "duck"]})
WIDE = MixParams(ramp_ms=2000)


def duck(spark, d):
    voice = signal.voice_ranges(v_series(spark, d), 50.0, 6.0)
    return mix.duck_ranges(stage(voice), v_segments(spark, d).select("video_id", "start_sec", "end_sec"))


def gains(spark, d):
    return mix.duck_envelope(v_series(spark, d), stage(duck(spark, d)), WIDE)


@gate("duck_ranges", oracle("duck", "SELECT * FROM duck"))
def duck_ranges(spark, d):
    return duck(spark, d)


@gate("duck_envelope", oracle("gains", f"SELECT video_id, ord, {six('gain')} AS gain FROM gains"))
def duck_envelope(spark, d):
    return gains(spark, d).select("video_id", "ord", r6("gain").alias("gain"))


@gate("duck_mix", oracle("gains", f"""
SELECT video_id, sample_no, {six('CASE WHEN peak > 32767 * 0.97::DOUBLE THEN mix * (32767 * 0.97::DOUBLE / peak) ELSE mix END')} AS mix FROM (
  SELECT *, max(abs(mix)) OVER (PARTITION BY video_id) AS peak FROM (
    SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY ord) - 1 AS sample_no, CASE WHEN 20 * log10(sqrt(avg(a * a) OVER (PARTITION BY video_id)) / 32768) >= -65 THEN a * gain ELSE 0 END
      + CASE WHEN level >= 50 THEN level * 75 * 1.4125375446227544::DOUBLE ELSE 0 END AS mix
    FROM (SELECT *, CASE WHEN video_id % 10 = 0 THEN level / 1000 ELSE level * 100 END AS a FROM gains)))
UNION ALL SELECT video_id, n + unnest([0, 1]), 0 FROM (SELECT video_id, count(*) AS n FROM gains GROUP BY video_id)"""))
def duck_mix(spark, d):
    """The samples of a video in their order, and two more that neither track has."""
    g = stage(scan(gains(spark, d), Axis(("video_id",), ("ord",), F.floor(F.col("ord") / 10_000).cast("long")), RowNumber("place")).withColumn("sample_no", F.col("place") - 1))
    bgm = g.select("video_id", "sample_no", F.when(F.col("video_id") % 10 == 0, F.col("level") / 1000).otherwise(F.col("level") * 100).alias("amplitude"), "gain")
    voice = g.filter(F.col("level") >= 50).select("video_id", "sample_no", (F.col("level") * 75).alias("amplitude"))
    lengths = g.groupBy("video_id").agg((F.count("*") + 2).alias("n"))
    return mix.duck_mix(bgm, voice, lengths, MixParams(voice_gain_db=3.0)).withColumn("mix", r6("mix"))


@gate("overlay_and_concat", oracle("np_placed seg_chunks", """
SELECT c.video_id, CAST(coalesce(o.off, 0) + c.i AS BIGINT) AS sample_no, coalesce(v.value, 0) AS value FROM
  (SELECT video_id, chunk_index, unnest(range(CAST(round_even((end_sec - start_sec) * 1000, 0) AS BIGINT) // 500)) AS i FROM seg_chunks) c
  JOIN (SELECT video_id, chunk_index, sum(CAST(round_even((end_sec - start_sec) * 1000, 0) AS BIGINT) // 500) OVER (PARTITION BY video_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off FROM seg_chunks) o USING (video_id, chunk_index)
  LEFT JOIN (SELECT c2.video_id, c2.chunk_index, c2.i, sum(p.id * 10::DOUBLE) AS value FROM (SELECT video_id, chunk_index, unnest(range(CAST(round_even((end_sec - start_sec) * 1000, 0) AS BIGINT) // 500)) AS i FROM seg_chunks) c2
      JOIN np_placed p ON p.video_id = c2.video_id AND p.chunk_index = c2.chunk_index AND c2.i * 500 >= p.placed_start_ms AND c2.i * 500 < p.placed_end_ms GROUP BY ALL) v
    ON v.video_id = c.video_id AND v.chunk_index = c.chunk_index AND v.i = c.i"""))
def overlay_and_concat(spark, d):
    owner = seg_chunks(spark, d).select(*CHUNKED, F.rint((F.col("end_sec") - F.col("start_sec")) * 1000).cast("long").alias("total_ms"))
    clips = narration_placed(spark, d).select(*CHUNKED, "placed_start_ms", "placed_end_ms", (F.col("id") * 10.0).alias("amplitude"))
    return mix.concat_chunks(mix.overlay(clips, owner, 500), owner, 500)


@gate("track_lengths", oracle("seg_chunks", """
SELECT * FROM (SELECT video_id, chunk_index, count(*) AS expected, count(*) FILTER ((video_id + i) % 97 <> 0) AS found FROM (
  SELECT video_id, chunk_index, unnest(range(CAST(round_even((end_sec - start_sec) * 1000, 0) AS BIGINT) // 500)) AS i FROM seg_chunks) GROUP BY ALL) WHERE expected <> found"""))
def track_lengths(spark, d):
    """Chunks of the joined track that are short, where every 97th sample got lost."""
    owner = seg_chunks(spark, d).select(*CHUNKED, F.rint((F.col("end_sec") - F.col("start_sec")) * 1000).cast("long").alias("total_ms"))
    clips = narration_placed(spark, d).select(*CHUNKED, "placed_start_ms", "placed_end_ms", (F.col("id") * 10.0).alias("amplitude"))
    samples = mix.overlay(clips, owner, 500).filter((F.col("video_id") + F.col("sample_no")) % 97 != 0)
    return mix.length_errors(samples, owner, 500)


# ---------------------------------------------------------------- subtitles
TRIM_SQL = f"regexp_replace(text, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"
VIEWS["sents"] = f"""SELECT video_id, id, seg_start, seg_end, CAST(pos AS INTEGER) AS pos, parts[pos + 1] AS sentence, row_number() OVER (PARTITION BY video_id ORDER BY seg_start, id, pos) AS sentence_no FROM (
    SELECT *, unnest(range(len(parts))) AS pos FROM (SELECT video_id, id, start_sec AS seg_start, end_sec AS seg_end,
      list_filter(string_split(regexp_replace({TRIM_SQL}, '([.!?…]){WS_SQL}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: NOT regexp_matches(x, '^{WS_SQL}*$')) AS parts FROM v_segments))"""
VIEWS["seg_durs"] = """SELECT video_id, id, count(*) AS cnt, list((seg_end - seg_start) * (length(sentence) / total) ORDER BY pos) AS durs FROM (
      SELECT *, sum(length(sentence)) OVER (PARTITION BY video_id, id) AS total FROM sents) GROUP BY video_id, id"""
# times add up sentence by sentence, in the order in which they are read
VIEWS["est"] = """SELECT video_id, id, seg_start, pos, sentence AS text, list_reduce(list_concat([seg_start], durs[1:pos]), lambda a, b: a + b) AS start_sec,
    CASE WHEN pos = cnt - 1 THEN seg_end ELSE least(seg_end, list_reduce(list_concat([seg_start], durs[1:pos + 1]), lambda a, b: a + b)) END AS end_sec FROM sents JOIN seg_durs USING (video_id, id)"""


def repaired_sql(source: str, extra: str = "") -> str:
    return f"""SELECT video_id, id, pos, text{extra}, cue_no, start_sec, CASE WHEN nxt < e THEN nxt ELSE e END AS end_sec FROM (
      SELECT *, lead(start_sec) OVER w AS nxt, row_number() OVER w AS cue_no FROM (SELECT *, CASE WHEN end_sec - start_sec < 0.5::DOUBLE THEN start_sec + 0.5::DOUBLE ELSE end_sec END AS e FROM {source})
      WINDOW w AS (PARTITION BY video_id ORDER BY seg_start, id, pos))"""


VIEWS["cues"] = repaired_sql("est")
VIEWS["words_used"] = "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY w_start, turn, k) AS word_no FROM v_words"
VIEWS["need"] = f"""SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY sentence_no) - n AS before, sum(n) OVER (PARTITION BY video_id) AS expected FROM (
    SELECT *, greatest(1, len({tokens_sql('sentence')})) AS n FROM sents)"""
VIEWS["aligned"] = """SELECT s.video_id, s.id, s.seg_start, s.seg_end, s.pos, s.sentence, s.sentence_no, s.accepted,
    CASE WHEN s.accepted THEN coalesce((SELECT w_start FROM words_used w WHERE w.video_id = s.video_id AND w.word_no = s.before + 1), s.last_end) END AS aligned_start,
    CASE WHEN s.accepted THEN coalesce((SELECT arg_max(w_end, word_no) FROM words_used w WHERE w.video_id = s.video_id AND w.word_no > s.before AND w.word_no <= s.before + s.n), s.last_end) END AS aligned_end
    FROM (SELECT n.*, st.last_end, coalesce(st.actual, 0) > 0 AND abs(coalesce(st.actual, 0) - n.expected) / n.expected <= 0.25::DOUBLE AS accepted
      FROM need n LEFT JOIN (SELECT video_id, count(*) AS actual, arg_max(w_end, word_no) AS last_end FROM words_used GROUP BY 1) st USING (video_id)) s"""
VIEWS["chosen"] = """SELECT e.video_id, e.id, e.seg_start, e.pos, e.text, CASE WHEN a.accepted THEN 'aligned' ELSE 'estimated' END AS source,
    CASE WHEN a.accepted THEN a.aligned_start ELSE e.start_sec END AS start_sec, CASE WHEN a.accepted THEN a.aligned_end ELSE e.end_sec END AS end_sec FROM est e JOIN aligned a USING (video_id, id, pos)"""
DEPENDS.update({"sents": ["v_segments"], "seg_durs": ["sents"], "est": ["sents", "seg_durs"], "cues": ["est"], "words_used": ["v_words"], "need": ["sents"], "aligned": ["need", "words_used"], "chosen": ["est", "aligned"]})


def aligned(spark, d):
    return subtitles.align_words(subtitles.numbered_sentences(v_segments(spark, d)), v_words(spark, d), ("w_start", "turn", "k"))


def secs(df, *names):
    return df.withColumns({c: r6(c) for c in names})


@gate("sentences", oracle("sents", "SELECT video_id, id, pos, sentence, sentence_no FROM sents"))
def sentences(spark, d):
    return subtitles.numbered_sentences(v_segments(spark, d)).select("video_id", "id", "pos", "sentence", "sentence_no")


@gate("split_cues", oracle("est", f"SELECT video_id, id, pos, text, {six('start_sec')} AS start_sec, {six('end_sec')} AS end_sec FROM est"))
def split_cues(spark, d):
    return secs(subtitles.split_cues(v_segments(spark, d)).drop("seg_start"), "start_sec", "end_sec")


@gate("split_cues_whole", oracle("v_segments", f"SELECT video_id, id, 0 AS pos, {TRIM_SQL} AS text, start_sec, end_sec FROM v_segments WHERE {TRIM_SQL} <> ''"))
def split_cues_whole(spark, d):
    return subtitles.split_cues(v_segments(spark, d), split=False).drop("seg_start")


@gate("cue_repair", oracle("cues", f"SELECT video_id, id, pos, text, cue_no, {six('start_sec')} AS start_sec, {six('end_sec')} AS end_sec FROM cues"))
def cue_repair(spark, d):
    return secs(subtitles.cue_repair(subtitles.split_cues(v_segments(spark, d))).drop("seg_start"), "start_sec", "end_sec")


@gate("align_words", oracle("aligned", f"SELECT video_id, id, pos, sentence_no, accepted, {six('aligned_start')} AS aligned_start, {six('aligned_end')} AS aligned_end FROM aligned"))
def align_words(spark, d):
    return secs(aligned(spark, d).select("video_id", "id", "pos", "sentence_no", "accepted", "aligned_start", "aligned_end"), "aligned_start", "aligned_end")


@gate("cue_source", oracle("chosen", f"SELECT video_id, id, pos, text, source, cue_no, {six('start_sec')} AS start_sec, {six('end_sec')} AS end_sec FROM ({repaired_sql('chosen', ', source')})"))
def cue_source(spark, d):
    chosen = subtitles.choose_cues(subtitles.split_cues(v_segments(spark, d)), stage(aligned(spark, d)))
    return secs(subtitles.cue_repair(stage(chosen)).drop("seg_start"), "start_sec", "end_sec")


@gate("srt_render", oracle("cues", f"""
SELECT video_id, string_agg(cue_no || chr(10) || {clock_sql('start_sec', ',')} || ' --> ' || {clock_sql('end_sec', ',')} || chr(10) || wrapped || chr(10) || chr(10), '' ORDER BY cue_no) AS srt
FROM (SELECT *, {WRAP_SQL.format(toks='toks', t='text', fit='fit')} AS wrapped FROM (SELECT *, {FIT_SQL} AS fit FROM (SELECT *, {tokens_sql('text')} AS toks FROM cues))) GROUP BY ALL"""))
def srt_render(spark, d):
    """The SRT documents, packed into files, as a reader finds them."""
    path = new_folder(spark, "srt")
    subtitles.pack_srt(subtitles.cue_repair(subtitles.split_cues(v_segments(spark, d))), path)
    return subtitles.read_srt(spark, path)


# ---------------------------------------------------------------- ledger
STAGE_SQL = "['01_extracted', '02_script', '03_tts_done', '04_assembled']"
VIEWS["led"] = f"SELECT video_id, chunk_index, n_stages, i AS stage_no, {STAGE_SQL}[i] AS stage FROM (SELECT *, unnest(range(1, n_stages + 1)) AS i FROM v_ledger)"
VIEWS["led_done"] = "SELECT * FROM led WHERE NOT (n_stages = 3 AND stage_no = 2)"
VIEWS["matrix"] = f"""SELECT *, s4 AS done, {STAGE_SQL}[CASE WHEN NOT s1 THEN 1 WHEN NOT s2 THEN 2 WHEN NOT s3 THEN 3 WHEN NOT s4 THEN 4 END] AS next_stage FROM (
    SELECT l.video_id, l.chunk_index, coalesce(bool_or(stage_no = 1), false) AS s1, coalesce(bool_or(stage_no = 2), false) AS s2, coalesce(bool_or(stage_no = 3), false) AS s3, coalesce(bool_or(stage_no = 4), false) AS s4
    FROM v_ledger l LEFT JOIN led_done d USING (video_id, chunk_index) GROUP BY ALL)"""
DEPENDS.update({"led": ["v_ledger"], "led_done": ["led"], "matrix": ["v_ledger", "led_done"]})


def stages(spark, d):
    return v_ledger(spark, d).select(*CHUNKED, "n_stages", F.posexplode(F.slice(F.array(*map(F.lit, ledger.STAGES)), F.lit(1), F.col("n_stages"))).alias("i", "stage")).select(
        *CHUNKED, "n_stages", (F.col("i") + 1).alias("stage_no"), "stage")


def done(spark, d):
    payloads = stages(spark, d).filter(~((F.col("n_stages") == 3) & (F.col("stage_no") == 2))).select(*CHUNKED, "stage")  # scripts of unfinished chunks got lost
    return ledger.recorded(stages(spark, d), payloads)


def matrix(spark, d):
    return ledger.status_matrix(done(spark, d), v_ledger(spark, d).select(*CHUNKED))


@gate("fingerprint", """SELECT p_partkey AS video_id, substr(sha1(to_json({'brand': p_brand, 'chunk_target_sec': 240.0::DOUBLE, 'duration': round_even(p_retailprice * 100, 0) / 100::DOUBLE, 'language': 'vi', 'name': p_name,
    'narration_mode': 'per_scene', 'size': p_size})::VARCHAR), 1, 12) AS fingerprint FROM part""")
def fingerprint(spark, d):
    fields = {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size"), "duration": F.rint(F.col("p_retailprice") * 100) / 100.0,
              "language": F.lit("vi"), "chunk_target_sec": F.lit(240.0), "narration_mode": F.lit("per_scene")}
    return table(spark, d, "part").select(F.col("p_partkey").alias("video_id"), ledger.fingerprint(fields).alias("fingerprint"))


@gate("stage_has", oracle("led_done", "SELECT video_id, chunk_index, stage FROM led_done"))
def stage_has(spark, d):
    return done(spark, d).select(*CHUNKED, "stage")


@gate("next_stage", oracle("matrix", "SELECT video_id, chunk_index, next_stage FROM matrix"))
def next_stage(spark, d):
    return matrix(spark, d).select(*CHUNKED, "next_stage")


@gate("status_matrix", oracle("matrix", "SELECT video_id, chunk_index, s1 AS has_frames, s2 AS has_script, s3 AS has_speech, s4 AS has_audio, done FROM matrix"))
def status_matrix(spark, d):
    return matrix(spark, d).drop("next_stage")


@gate("status_summary", oracle("matrix", """
SELECT video_id, count(*) AS chunks, count(*) FILTER (done) AS chunks_done, bool_and(s2) AS all_scripts_ready, bool_and(s3) AS all_speech_ready,
    coalesce(min(chunk_index) FILTER (NOT done), max(chunk_index)) AS first_unfinished,
    CASE WHEN NOT bool_and(s1) THEN 1 WHEN NOT bool_and(s2) THEN 2 WHEN NOT bool_and(s3) THEN 3 WHEN NOT bool_and(s4) THEN 4 ELSE 5 END AS steps_complete FROM matrix GROUP BY video_id"""))
def status_summary(spark, d):
    return ledger.status_summary(matrix(spark, d))


@gate("invalidate_from", oracle("led", """
SELECT video_id, chunk_index, stage FROM led WHERE NOT ((video_id % 5 = 0 AND chunk_index <= 2 AND stage_no >= 2) OR (video_id % 5 = 1 AND stage_no >= 3))"""))
def invalidate_from(spark, d):
    orders = v_ledger(spark, d).select(*CHUNKED, F.when((F.col("video_id") % 5 == 0) & (F.col("chunk_index") <= 2), ledger.STAGES[1]).when(
        F.col("video_id") % 5 == 1, ledger.STAGES[2]).alias("from_stage")).filter(F.col("from_stage").isNotNull())
    return ledger.invalidate_from(stages(spark, d), orders).select(*CHUNKED, "stage")


@gate("pending_work", oracle("v_ledger led", f"""
SELECT fp AS fingerprint, video_id, chunk_index, stage FROM (SELECT video_id, chunk_index, n_stages, i, {STAGE_SQL}[i] AS stage, 'fp' || video_id % 3 AS fp FROM (SELECT *, unnest(range(1, 5)) AS i FROM v_ledger))
WHERE NOT (i <= n_stages AND video_id % 4 <> 0)"""))
def pending_work(spark, d):
    every = F.explode(F.array(*map(F.lit, ledger.STAGES))).alias("stage")
    plan = v_ledger(spark, d).select(F.concat(F.lit("fp"), (F.col("video_id") % 3).cast("string")).alias("fingerprint"), *CHUNKED, every)
    stored = stages(spark, d).select(F.when(F.col("video_id") % 4 == 0, "other").otherwise(F.concat(F.lit("fp"), (F.col("video_id") % 3).cast("string"))).alias("fingerprint"), *CHUNKED, "stage")
    return ledger.pending_work(plan, stored)


@gate("cache_lookup", oracle("v_candidates", """
SELECT video_id, ord, CASE WHEN hit THEN '[' || ord || ']' END AS cached, hit FROM (SELECT *, k < 50 AND ord % 6 <> 4 AND ord % 5 <> 0 AND ord % 7 <> 0 AS hit FROM v_candidates)"""))
def cache_lookup(spark, d):
    c = v_candidates(spark, d).withColumn("fingerprint", F.concat(F.lit("v"), F.col("video_id").cast("string"), F.lit("-"), F.col("ord").cast("string")))
    stored = c.filter(F.col("k") < 50).select(
        F.when(F.col("ord") % 5 == 0, F.concat("fingerprint", F.lit("x"))).otherwise(F.col("fingerprint")).alias("fingerprint"),
        (F.col("start_sec") + F.when(F.col("ord") % 6 == 4, 0.01).otherwise(0.0001)).alias("start_sec"), "end_sec",
        F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("]")).alias("segments"))
    asked = c.select("video_id", "ord", "fingerprint", "start_sec", "end_sec", (F.col("ord") % 7 == 0).alias("force"))
    return ledger.cache_lookup(asked, stored).select("video_id", "ord", "cached", "hit")


@gate("cache_validity", oracle("v_frames", """
SELECT video_id, chunk_index, count(*) AS frames, count(*) FILTER (hist[1] < 0.005) AS missing, bool_and(hist[1] >= 0.005) AS valid FROM (SELECT *, CAST(floor(t_sec / 10) AS INTEGER) AS chunk_index FROM v_frames) GROUP BY ALL"""))
def cache_validity(spark, d):
    f = v_frames(spark, d).select("video_id", F.floor(F.col("t_sec") / 10).cast("int").alias("chunk_index"), F.format_string("/f/%d/frame_%04d.jpg", "video_id", "idx").alias("path"), "hist")
    return ledger.cache_validity(f.select(*CHUNKED, "path"), f.filter(F.col("hist")[0] >= 0.005).select("path"))


@gate("plan_guard", oracle("v_ledger", "SELECT video_id, chunk_index, 'fp' || video_id % 3 AS fingerprint FROM v_ledger WHERE video_id % 4 <> 0"))
def plan_guard(spark, d):
    plans = v_ledger(spark, d).select(*CHUNKED, F.concat(F.lit("fp"), (F.col("video_id") % 3).cast("string")).alias("fingerprint"))
    current = v_ledger(spark, d).select("video_id", F.concat(F.lit("fp"), F.when(F.col("video_id") % 4 == 0, 9).otherwise(F.col("video_id") % 3).cast("string")).alias("fingerprint")).distinct()
    return ledger.plan_guard(plans, current)


@gate("source_resolution", """
SELECT p.page_id AS item_id, p.url, l.doc_id IS NOT NULL AND p.page_id % 6 <> 0 AS have_video, p.page_id % 3 = 0 AND p.page_id % 6 <> 0 AS have_script,
    CASE WHEN l.doc_id IS NOT NULL AND p.page_id % 6 <> 0 THEN CASE WHEN p.page_id % 3 = 0 AND p.page_id % 6 <> 0 THEN 'reuse' ELSE 'fetch script' END
      WHEN p.page_id % 3 = 0 AND p.page_id % 6 <> 0 THEN 'fetch video' ELSE 'fetch both' END AS action
FROM pages p LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = p.page_id""")
def source_resolution(spark, d):
    items = table(spark, d, "pages").select(F.col("page_id").alias("item_id"), "url", (F.col("page_id") % 6 == 0).alias("force"))
    videos = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"))
    scripts = table(spark, d, "pages").select(F.col("page_id").alias("item_id"), F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise("elsewhere").alias("script_url"))
    return ledger.source_resolution(items, videos, scripts)
