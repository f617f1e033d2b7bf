"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.segments import coerce_segments
from ..sources import logs, media, scripts
from .carriers import oracle, table, v_formats, v_frames, v_lines, v_media_json, v_segments, v_series
from ..functions.scoring import r6
from ..session import new_folder
from .registry import gate
from .scalars import certainty_sql, clean_sql, clock_sql, tone_sql


@gate("media_catalog", """
SELECT p_partkey AS video_id, dur AS duration_sec, CAST(round_even(dur * 1000, 0) AS BIGINT) AS duration_ms,
    p_partkey % 17 = 0 OR p_partkey % 3 <> 0 AS has_audio,
    CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_size * 40 END AS width, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_size * 20 END AS height,
    CASE WHEN p_partkey % 17 = 0 OR p_partkey % 11 = 0 THEN 25 WHEN p_partkey % 11 = 1 THEN round_even((30000 / 1001::DOUBLE) * 1000000::DOUBLE, 0) / 1000000::DOUBLE ELSE p_size::DOUBLE END AS fps,
    CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_brand END AS codec,
    CASE WHEN p_partkey % 17 = 0 THEN 'no video stream' END AS reason
FROM (SELECT *, CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice WHEN p_partkey % 17 <> 0 THEN 7.25::DOUBLE END AS dur FROM part)""")
def media_catalog(spark, d):
    return media.media_catalog(v_media_json(spark, d)).withColumn("fps", r6("fps"))


def rendered_documents(spark, d):
    """Scripts as JSON documents of at most 50 rows: plain arrays, objects around them, and some without any array."""
    s = v_segments(spark, d)
    row = F.struct(
        F.when(F.col("id") % 4 == 0, F.lit("x")).otherwise(F.col("id").cast("string")).alias("id"),
        F.when(F.col("id") % 5 == 0, F.lit("soon")).otherwise(F.col("start_sec").cast("string")).alias("start_time"),
        F.when(F.col("id") % 3 == 0, F.col("start_sec") - 1).otherwise(F.col("end_sec")).cast("string").alias("end"),
        "text", F.col("tone").alias("emotion"), "certainty")
    docs = s.groupBy("video_id", F.floor((F.col("id") - 1) / 50).alias("part")).agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("id", row.alias("row")))), lambda x: x["row"])).alias("rows"))
    kind = F.col("video_id") % 5
    return docs.select("video_id", "part", F.when(kind == 4, F.lit('{"note": "none"}')).when(
        kind == 3, F.concat(F.lit('{"version": 1, "segments": '), F.col("rows"), F.lit("}"))).otherwise(F.col("rows")).alias("doc"))


@gate("script_scan", oracle("v_segments", f"""
SELECT video_id, pos, CASE WHEN id % 4 = 0 THEN 0 ELSE id END AS id, CASE WHEN id % 5 <> 0 THEN start_sec END AS start_sec,
    CASE WHEN id % 3 = 0 THEN start_sec - 1 ELSE end_sec END AS end_sec, {clean_sql('text')} AS text, {tone_sql('tone')} AS tone, {certainty_sql('certainty')} AS certainty,
    CASE WHEN id % 5 = 0 OR (id % 3 = 0 AND start_sec < 1) THEN 'bad time' WHEN {clean_sql('text')} = '' THEN 'empty text' WHEN id % 3 = 0 THEN 'end before start' END AS reason
FROM (SELECT *, CAST((id - 1) % 50 AS INTEGER) AS pos FROM v_segments WHERE video_id % 5 <> 4)
UNION ALL SELECT DISTINCT video_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no array of rows' FROM (SELECT DISTINCT video_id, (id - 1) // 50 AS part FROM v_segments WHERE video_id % 5 = 4)"""))
def script_scan(spark, d):
    """Every row of every document with its reason, null if it is accepted, and a row for each document without rows."""
    rows, documents = scripts.script_rows(rendered_documents(spark, d))
    columns = ("video_id", "pos", F.col("id").cast("long").alias("id"), "start_sec", "end_sec", "text", "tone", "certainty", "reason")
    return coerce_segments(rows).select(*columns).unionByName(documents.select("video_id", "reason"), allowMissingColumns=True)


def log_lines(series):
    """The level series written as lines of a detection log: starts, ends and other lines."""
    kind, t = F.col("ord") % 4, F.col("t_sec")
    line = (
        F.when(kind == 0, F.concat(F.lit("[detect @ 0x1] silence_start: "), F.format_string("%.3f", t - 2)))
        .when(kind == 1, F.concat(F.lit("[detect @ 0x1] silence_end: "), F.format_string("%.3f", t), F.lit(" | silence_duration: 2")))
        .otherwise(F.lit("frame=1 fps=0"))
    )
    return series.select("video_id", F.col("ord").alias("line_no"), line.alias("line"))


@gate("silence_log_scan", oracle("v_series", """
SELECT video_id, ord AS line_no, greatest(opened, 0::DOUBLE) AS start_sec, t_sec AS end_sec
FROM (SELECT *, lag(CASE WHEN ord % 4 = 0 THEN t_sec - 2 END) OVER (PARTITION BY video_id ORDER BY ord) AS opened
      FROM v_series WHERE ord % 4 IN (0, 1)) WHERE ord % 4 = 1 AND opened IS NOT NULL"""))
def silence_log_scan(spark, d):
    return logs.silences_from_log(log_lines(v_series(spark, d)), "video_id")


@gate("frame_listing", oracle("v_frames", """SELECT video_id, idx AS frame_index, idx * 100 / 1000::DOUBLE AS timestamp_sec
FROM v_frames WHERE idx % 7 <> 0"""))
def frame_listing(spark, d):
    name = F.when(F.col("idx") % 7 == 0, F.format_string("/f/ff_%05d.jpg", "idx")).otherwise(
        F.format_string("/f/frame_%04d_%08d.jpg", F.col("idx"), F.rint(F.col("t_sec") * 1000).cast("long")))
    return logs.parse_frame_names(v_frames(spark, d).select("video_id", "idx", name.alias("path")), "path").select(
        "video_id", "frame_index", "timestamp_sec")


@gate("script_sink", oracle("v_segments", f"""
SELECT video_id, chunk_index, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index, start_sec, id) AS id,
    {clock_sql('start_sec')} AS start_time, {clock_sql('end_sec')} AS end_time,
    round_even((end_sec - start_sec) * 1000, 0) / 1000::DOUBLE AS duration_sec, text, tone, certainty
FROM (SELECT *, CAST(floor((start_sec + end_sec) / 2 / 60) AS INTEGER) AS chunk_index FROM v_segments)"""))
def script_sink(spark, d):
    """The script in its files, as a reader finds it."""
    seg = v_segments(spark, d).withColumn("chunk_index", F.floor((F.col("start_sec") + F.col("end_sec")) / 2 / 60).cast("int"))
    path = new_folder(spark, "script")
    scripts.write_script(scripts.numbered_script(seg), path)
    return scripts.read_script(spark, path)


@gate("log_tail", oracle("v_lines", """
SELECT source, line_no, line FROM (SELECT doc_id AS source, line_no, line,
    row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS r FROM v_lines) WHERE r <= 5
UNION ALL SELECT doc_id, 0, '(no log lines)' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v_lines)"""))
def log_tail(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source"))
    lines = v_lines(spark, d).withColumnRenamed("doc_id", "source")
    return logs.log_tail(docs, lines, 5)


URLS = """CASE page_id % 7 WHEN 0 THEN ' https://www.youtube.com/watch?v=ab_' || page_id || '&from=' || url WHEN 1 THEN 'https://youtu.be/cd-' || page_id || '?from=' || url || ' '
    WHEN 2 THEN 'HTTP://YouTube.com/shorts/' || page_id || '?from=' || url WHEN 3 THEN 'youtube.com/watch?v=x&from=' || url WHEN 4 THEN '  '
    WHEN 5 THEN 'https://www.youtube.com/watch?list=' || url ELSE url END"""


@gate("video_url_filter", f"""
SELECT page_id, trim({URLS}) AS url, CASE page_id % 7 WHEN 4 THEN 'empty' WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL
    ELSE 'not a video link' END AS reason FROM pages""")
def video_url_filter(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.expr(URLS).alias("url"))
    return media.check_urls(pages)


@gate("format_pick", oracle("v_formats", """
SELECT video_id, tier, height, codec, ext, format_no, part_key, supp_key FROM (SELECT *, row_number() OVER (PARTITION BY video_id
    ORDER BY tier, height DESC, format_no, part_key, supp_key) AS r FROM (SELECT *, CASE WHEN height <= 1080 AND codec = 'avc1' AND ext = 'mp4' THEN 0
    WHEN height <= 1080 AND ext = 'mp4' THEN 1 WHEN height <= 1080 THEN 2 ELSE 3 END AS tier FROM v_formats)) WHERE r = 1"""))
def format_pick(spark, d):
    return media.pick_format(v_formats(spark, d), 1080, tie_break=("format_no", "part_key", "supp_key"))


@gate("format_pick_tall", oracle("v_formats", """
SELECT video_id, tier, height, codec, ext, format_no, part_key, supp_key FROM (SELECT *, row_number() OVER (PARTITION BY video_id
    ORDER BY tier, height DESC, format_no, part_key, supp_key) AS r FROM (SELECT *, CASE WHEN height <= 1440 AND ext = 'mp4' THEN 1
    WHEN height <= 1440 THEN 2 ELSE 3 END AS tier FROM v_formats)) WHERE r = 1"""))
def format_pick_tall(spark, d):
    return media.pick_format(v_formats(spark, d), 1440, tie_break=("format_no", "part_key", "supp_key"))
