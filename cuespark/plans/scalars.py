"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text, timecode, voices
from ..params import ScriptParams
from .carriers import WS_SQL, oracle, table, v_candidates, v_segments, v_series
from ..functions.scoring import r6
from .registry import gate

CLOCK_SQL = """printf('%02d:%02d:%02d{sep}%03d', {ms} // 3600000, {ms} % 3600000 // 60000, {ms} % 60000 // 1000, {ms} % 1000)"""


def clock_sql(sec: str, sep: str = ".") -> str:
    return CLOCK_SQL.format(sep=sep, ms=f"greatest(CAST(round_even(({sec}) * 1000, 0) AS BIGINT), 0)")


def words_sql(t: str) -> str:
    return rf"len(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'))"


def squeeze_sql(t: str) -> str:
    return f"trim(regexp_replace({t}, '{WS_SQL}+', ' ', 'g'))"


def clean_sql(t: str) -> str:
    bare = f"regexp_replace(regexp_replace({t}, '[*_`#>~]+', '', 'g'), '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{FE0F}}]', '', 'g')"
    return squeeze_sql(bare)


def accents_sql(t: str) -> str:
    return f"strip_accents(replace(replace({t}, 'đ', 'd'), 'Đ', 'D'))"


def tone_sql(t: str) -> str:
    s = squeeze_sql(f"translate(lower({accents_sql(f'coalesce({t}, chr(32))')}), '_-', '  ')")
    arms = " ".join(f"WHEN contains({s}, '{n}') THEN '{v}'" for n, v in [(x, x) for x in text.TONES] + list(text.TONE_ALIASES))
    return f"CASE {arms} ELSE 'trung tinh' END"


def certainty_sql(c: str) -> str:
    return (f"CASE WHEN lower({squeeze_sql(c)}) IN ('observed_fact','safe_inference','creative_framing','user_provided_fact') "
            f"THEN lower({squeeze_sql(c)}) ELSE 'observed_fact' END")


def tokens_sql(t: str) -> str:
    return f"list_filter(string_split({squeeze_sql(t)}, ' '), lambda x: x <> '')"


def truncated_ctes(source: str, keep: str = "video_id, id") -> list[str]:
    """CTEs ending in ``truncated(video_id, id, short_text)`` for ``source(..., text, lim)``."""
    return [
        f"tok AS (SELECT {keep}, lim, {tokens_sql('text')} AS toks FROM {source})",
        f"siz AS (SELECT *, list_transform(toks, lambda x: {words_sql('x')}) AS sizes FROM tok)",
        f"cut1 AS (SELECT {keep}, array_to_string(toks[1:len(list_filter(range(1, len(toks) + 1), "
        "lambda i: coalesce(list_sum(sizes[1:i]), 0) <= lim))], ' ') AS cut FROM siz)",
        f"cut2 AS (SELECT {keep}, cut, regexp_extract(cut, '(?s)^(.*[.!?…,;:])', 1) AS upto FROM cut1)",
        f"cut3 AS (SELECT {keep}, regexp_replace(CASE WHEN length(upto) >= 1 AND length(upto) >= length(cut) * 0.6::DOUBLE THEN upto ELSE cut END, "
        "'[ ,;:-]+$', '') AS cut FROM cut2)",
        f"truncated AS (SELECT {keep}, CASE WHEN regexp_matches(cut, '[.!?…]$') THEN cut ELSE cut || '.' END AS short_text FROM cut3)",
    ]


LIMIT_SQL = "greatest(1, CAST(floor((end_sec - start_sec) * {wps}::DOUBLE * 1.15::DOUBLE) AS INTEGER))"


@gate("parse_timestamp", oracle("v_series", """
SELECT video_id, ord, CASE ord % 7 WHEN 0 THEN t_sec WHEN 1 THEN (ms // 60000) * 60 + (ms % 60000) / 1000::DOUBLE
    WHEN 2 THEN ((ms // 3600000) * 60 + ms % 3600000 // 60000) * 60 + (ms % 60000) / 1000::DOUBLE END AS seconds
FROM (SELECT *, CAST(round_even(t_sec * 1000, 0) AS BIGINT) AS ms FROM v_series)"""))
def parse_timestamp(spark, d):
    ms = timecode.millis(F.col("t_sec"))
    tail = F.format_string("%02d,%03d", (F.floor(ms % 60000 / 1000)).cast("long"), (ms % 1000).cast("long"))
    minutes = F.floor(ms / 60000).cast("string")
    kind = F.col("ord") % 7
    raw = (
        F.when(kind == 0, F.concat(F.lit(" "), F.col("t_sec").cast("string")))
        .when(kind == 1, F.concat_ws(":", minutes, tail)).when(kind == 2, timecode.format_timestamp(F.col("t_sec")))
        .when(kind == 3, F.lit("")).when(kind == 4, F.lit("1:2:3:4")).when(kind == 5, F.lit("soon")).otherwise(F.lit("-4.5"))
    )
    return v_series(spark, d).select("video_id", "ord", timecode.parse_timestamp(raw).alias("seconds"))


@gate("format_timestamp", oracle("v_series", f"SELECT video_id, ord, {clock_sql('t_sec * 137.25')} AS clock FROM v_series"))
def format_timestamp(spark, d):
    return v_series(spark, d).select("video_id", "ord", timecode.format_timestamp(F.col("t_sec") * 137.25).alias("clock"))


@gate("srt_timestamp", oracle("v_series", f"SELECT video_id, ord, {clock_sql('t_sec - 1', ',')} AS clock FROM v_series"))
def srt_timestamp(spark, d):
    return v_series(spark, d).select("video_id", "ord", timecode.srt_timestamp(F.col("t_sec") - 1).alias("clock"))


@gate("strip_accents", f"SELECT doc_id, {accents_sql('text')} AS plain FROM documents")
def strip_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@gate("count_words", f"SELECT doc_id, CAST({words_sql('text')} AS INTEGER) AS words FROM documents")
def count_words(spark, d):
    return table(spark, d, "documents").select("doc_id", text.count_words(F.col("text")).alias("words"))


@gate("clean_text", f"""SELECT doc_id, {clean_sql('text')} AS cleaned,
{squeeze_sql("regexp_replace(text, '[*_`#<>~]+', '', 'g')")} AS spoken FROM documents""")
def clean_text(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.clean_text(F.col("text")).alias("cleaned"), text.clean_speech_text(F.col("text")).alias("spoken"))


@gate("normalize_tone", oracle("v_segments", f"SELECT video_id, id, {tone_sql('tone')} AS tone_name FROM v_segments"))
def normalize_tone(spark, d):
    return v_segments(spark, d).select("video_id", "id", text.normalize_tone(F.col("tone")).alias("tone_name"))


@gate("normalize_certainty", oracle("v_segments", f"SELECT video_id, id, {certainty_sql('certainty')} AS label FROM v_segments"))
def normalize_certainty(spark, d):
    return v_segments(spark, d).select("video_id", "id", text.normalize_certainty(F.col("certainty")).alias("label"))


PROSODY_SQL = "(VALUES ('vui ve','+5%','+3Hz','+0%'),('hao hung','+10%','+6Hz','+5%'),('tram am','-8%','-4Hz','-3%'),('trung tinh','+0%','+0Hz','+0%')) p(tone_name, rate, pitch, volume)"


@gate("tone_prosody", oracle("v_segments", f"""
SELECT video_id, id, rate, pitch, volume, round_even((factor) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS rate_factor,
    greatest(0.7::DOUBLE, least(1.2::DOUBLE, round_even(factor * 100, 0) / 100::DOUBLE)) AS speed
FROM (SELECT s.*, p.*, 1 + CAST(replace(rate, '%', '') AS DOUBLE) / 100::DOUBLE AS factor
      FROM (SELECT video_id, id, {tone_sql('tone')} AS tone_name FROM v_segments) s JOIN {PROSODY_SQL} USING (tone_name))"""))
def tone_prosody(spark, d):
    rate, pitch, volume = voices.prosody(F.col("tone_name"))
    return (
        v_segments(spark, d).withColumn("tone_name", text.normalize_tone(F.col("tone")))
        .select("video_id", "id", rate.alias("rate"), pitch.alias("pitch"), volume.alias("volume"))
        .withColumn("rate_factor", r6(voices.rate_factor(F.col("rate"))))
        .withColumn("speed", voices.engine_speed(F.col("rate")))
    )


VOICES_SQL = ", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(voices.VOICES))


@gate("voice_pick", f"""
WITH cat AS (SELECT * FROM (VALUES {VOICES_SQL}) c(pos, lang, gender, voice)),
u AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'vi' ELSE 'en' END AS lang,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Nam' WHEN 'MACHINERY' THEN 'Nữ' WHEN 'FURNITURE' THEN 'other' END AS asked,
    CASE c_nationkey % 4 WHEN 0 THEN 'en-GB-RyanNeural' WHEN 1 THEN 'vi-VN-NamMinhNeural' WHEN 2 THEN 'en-IN-NeerjaNeural' END AS cur FROM customer),
g AS (SELECT u.*, coalesce((SELECT max(gender) FROM cat WHERE cat.lang = u.lang AND cat.gender = u.asked),
    (SELECT max(gender) FROM cat WHERE cat.lang = u.lang)) AS gender FROM u)
SELECT c_custkey, gender, coalesce((SELECT max(voice) FROM cat WHERE cat.lang = g.lang AND cat.gender = g.gender AND voice = g.cur),
    (SELECT arg_min(voice, pos) FROM cat WHERE cat.lang = g.lang AND cat.gender = g.gender)) AS voice FROM g""")
def voice_pick(spark, d):
    lang = F.when(F.col("c_custkey") % 3 == 0, "vi").otherwise("en")
    asked = (F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Nam").when(F.col("c_mktsegment") == "MACHINERY", "Nữ")
             .when(F.col("c_mktsegment") == "FURNITURE", "other"))
    cur = (F.when(F.col("c_nationkey") % 4 == 0, "en-GB-RyanNeural").when(F.col("c_nationkey") % 4 == 1, "vi-VN-NamMinhNeural")
           .when(F.col("c_nationkey") % 4 == 2, "en-IN-NeerjaNeural"))
    gender, voice = voices.pick_voice(lang, asked, cur)
    return table(spark, d, "customer").select("c_custkey", gender.alias("gender"), voice.alias("voice"))


@gate("missing_diacritics", f"""
SELECT doc_id, letters, round_even((marked / nullif(letters, 0)) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS marked_share,
    coalesce(letters >= 6 AND marked / nullif(letters, 0) < 0.08::DOUBLE, false) AS missing
FROM (SELECT doc_id, CAST(length(regexp_replace(lower(text), '[^\\p{{L}}]+', '', 'g')) AS INTEGER) AS letters,
    length(regexp_replace(lower(text), '[^{text.VI_MARKED}]+', '', 'g')) AS marked FROM documents)""")
def missing_diacritics(spark, d):
    letters, share = text.marked_share(F.col("text"))
    measured = text.once(table(spark, d, "documents").select("doc_id", "text"), {"m": F.struct(letters.alias("letters"), share.alias("share"))})
    low = F.coalesce((F.col("m.letters") >= 6) & (F.col("m.share") < 0.08), F.lit(False))
    return measured.select("doc_id", "m.letters", r6("m.share").alias("marked_share"), low.alias("missing"))


@gate("truncate_words", oracle("v_segments", "SELECT video_id, id, short_text FROM truncated",
      [f"lim AS (SELECT *, {LIMIT_SQL.format(wps='1.0')} AS lim FROM v_segments)", *truncated_ctes("lim")]))
def truncate_words(spark, d):
    limit = scoring.word_limit(F.col("end_sec") - F.col("start_sec"), 1.0, ScriptParams().wps_tolerance)
    return v_segments(spark, d).select("video_id", "id", text.truncate_words(F.col("text"), limit).alias("short_text"))


WRAP_SQL = """(CASE WHEN len({toks}) = 0 THEN {t} ELSE array_to_string({toks}[1:{fit}], ' ') ||
    CASE WHEN {fit} < len({toks}) THEN chr(10) || array_to_string({toks}[{fit} + 1:], ' ') ELSE '' END END)"""
FIT_SQL = "greatest(1, len(list_filter(range(1, len(toks) + 1), lambda i: length(array_to_string(toks[1:i], ' ')) <= 42)))"


@gate("wrap_lines", oracle("v_segments", f"SELECT video_id, id, {WRAP_SQL.format(toks='toks', t='text', fit='fit')} AS wrapped FROM f", [
    f"t AS (SELECT video_id, id, text, {tokens_sql('text')} AS toks FROM v_segments)", f"f AS (SELECT *, {FIT_SQL} AS fit FROM t)"]))
def wrap_lines(spark, d):
    return v_segments(spark, d).select("video_id", "id", text.wrap_two_lines(F.col("text")).alias("wrapped"))


@gate("snippet", f"SELECT conv_id, turn, substr({squeeze_sql('text')}, 1, 160) AS head FROM conversations")
def snippet(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.snippet(F.col("text")).alias("head"))


@gate("content_key", oracle("v_segments", f"""
SELECT content_key, substr(content_key, 1, 8) AS label, count(*) AS requests, min(spoken) AS spoken FROM (
  SELECT {squeeze_sql("regexp_replace(text, '[*_`#<>~]+', '', 'g')")} AS spoken,
    md5(concat_ws('|', {squeeze_sql("regexp_replace(text, '[*_`#<>~]+', '', 'g')")}, 'vi-VN-HoaiMyNeural', 'edge', rate || pitch || volume)) AS content_key
  FROM (SELECT *, {tone_sql('tone')} AS tone_name FROM v_segments) JOIN {PROSODY_SQL} USING (tone_name)) GROUP BY content_key"""))
def content_key(spark, d):
    rate, pitch, volume = voices.prosody(F.col("tone_name"))
    spoken = text.clean_speech_text(F.col("text"))
    key = text.content_key(spoken, F.lit("vi-VN-HoaiMyNeural"), F.lit("edge"), F.concat(rate, pitch, volume))
    return (
        v_segments(spark, d).withColumn("tone_name", text.normalize_tone(F.col("tone")))
        .select(key.alias("content_key"), spoken.alias("spoken"))
        .groupBy("content_key", text.key_label(F.col("content_key")).alias("label")).agg(F.count("*").alias("requests"), F.min("spoken").alias("spoken"))
    )


def raw_criteria(df):
    """Raw criteria texts of the candidates: some rows carry a plain score only, a few a score that is no number."""
    plain = F.col("ord") % 10 < 2
    k = F.col("k")

    def crit(expr):
        return F.when(~plain, expr.cast("string"))

    return df.withColumns({
        "story_value": crit(k / F.lit(100.0)), "visual_quality": crit(k * 7 % 100 / F.lit(100.0)),
        "context_value": crit(k * 13 % 100 / F.lit(100.0)), "transition_value": crit(k * 29 % 100 / F.lit(100.0)),
        "redundancy_penalty": crit(k * 3 % 100 / F.lit(200.0)),
        "score": F.when(F.col("ord") % 10 == 0, "high").when(F.col("ord") % 10 == 1, (k / F.lit(8.0)).cast("string")),
    })


def composite(df):
    names = ["story_value", "visual_quality", "context_value", "transition_value", "redundancy_penalty"]
    return scoring.composite_score({n: F.col(n) for n in names}, F.col("score"))


COMPOSITE_SQL = """CASE WHEN ord % 10 = 0 THEN 5.0::DOUBLE WHEN ord % 10 = 1 THEN k / 8::DOUBLE ELSE
    greatest(0::DOUBLE, 0::DOUBLE + 0.35::DOUBLE * least(1, k / 100::DOUBLE) + 0.25::DOUBLE * (k * 7 % 100 / 100::DOUBLE)
    + 0.15::DOUBLE * (k * 13 % 100 / 100::DOUBLE) + 0.15::DOUBLE * (k * 29 % 100 / 100::DOUBLE) - 0.3::DOUBLE * (k * 3 % 100 / 200::DOUBLE)) * 10 END"""


@gate("composite_score", oracle("v_candidates", f"SELECT video_id, ord, round_even(({COMPOSITE_SQL}) * 1000000::DOUBLE, 0) / 1000000::DOUBLE AS score FROM v_candidates"))
def composite_score(spark, d):
    return raw_criteria(v_candidates(spark, d)).select("video_id", "ord", r6(composite(None)).alias("score"))
