"""Carrier views: the driver's tables read as media tables, once for Spark and once as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS
from ..operators import ledger


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_series(spark, d) -> DataFrame:
    hours = F.expr("(unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 3600000D")
    return table(spark, d, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("ord"),
        (F.rint(hours) / F.lit(1000.0)).alias("t_sec"), F.col("value").alias("level"),
    )


def v_frames(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("idx"),
        (F.col("vec_id") / F.lit(10.0)).alias("t_sec"),
        F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("hist"),
    )


def v_segments(spark, d) -> DataFrame:
    n = F.length("text")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("video_id"), (F.col("turn") + 1).alias("id"),
        (F.col("turn") * 20 + (F.col("conv_id") % 7) * F.lit(0.5)).alias("start_sec"),
        (F.col("turn") * 20 + (F.col("conv_id") % 7) * F.lit(0.5) + 12 + n % 17).alias("end_sec"),
        "text",
        F.expr("CASE length(text) % 7 WHEN 0 THEN 'Vui_Vẻ' WHEN 1 THEN 'EXCITED' WHEN 2 THEN 'calm-deep' "
               "WHEN 3 THEN 'neutral' WHEN 4 THEN 'Nghiêm túc' WHEN 5 THEN role END").alias("tone"),
        F.expr("CASE length(text) % 5 WHEN 0 THEN 'observed_fact' WHEN 1 THEN ' Safe_Inference ' "
               "WHEN 2 THEN 'creative_framing' WHEN 3 THEN 'user_provided_fact' ELSE 'guess' END").alias("certainty"),
    )


def v_words(spark, d) -> DataFrame:
    tokens = F.filter(F.split("text", WS + "+"), lambda x: x != "")
    return (
        table(spark, d, "conversations")
        .select(F.col("conv_id").alias("video_id"), "turn", F.posexplode(tokens).alias("k", "word"))
        .filter(F.col("k") % 9 != 8)  # every ninth word is not recognised
        .select("video_id", "turn", "k", "word",
                (F.col("turn") * 20 + F.col("k") * F.lit(0.35)).alias("w_start"),
                (F.col("turn") * 20 + F.col("k") * F.lit(0.35) + F.lit(0.3)).alias("w_end"))
    )


def v_candidates(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    hours = F.expr("(unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 3600000D")
    t = F.rint(hours) / F.lit(1000.0)
    return table(spark, d, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("ord"),
        t.alias("start_sec"), (t + F.col("value") / F.lit(10.0)).alias("end_sec"), k.alias("k"),
    )


def v_ledger(spark, d) -> DataFrame:
    """Stages 1..n recorded per chunk of a video."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("chunk_index"), "l_quantity")
    return ledger.by_chunk(items).groupBy(*ledger.CHUNK).agg(F.ceil(F.max("l_quantity") / F.lit(12.5)).cast("int").alias("n_stages"))


def v_lines(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def v_formats(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), (F.col("l_quantity") * 40).cast("int").alias("height"),
        F.when(F.col("l_returnflag") == "A", "avc1").when(F.col("l_returnflag") == "N", "av01").otherwise("vp9").alias("codec"),
        F.when(F.col("l_linestatus") == "O", "mp4").otherwise("webm").alias("ext"),
        F.col("l_linenumber").alias("format_no"), F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"),
    )


def v_media_json(spark, d) -> DataFrame:
    video = F.struct(
        F.lit("video").alias("codec_type"), F.col("p_brand").alias("codec_name"),
        (F.col("p_size") * 40).alias("width"), (F.col("p_size") * 20).alias("height"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit("0/0")).when(F.col("p_partkey") % 11 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.col("p_size").cast("string"), F.lit("/1"))).alias("avg_frame_rate"),
        F.lit("30000/1001").alias("r_frame_rate"),
        F.when(F.col("p_partkey") % 13 == 0, F.lit("7.25")).alias("duration"),
    )
    audio = F.struct(
        F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit(0).alias("width"), F.lit(0).alias("height"),
        F.lit("0/0").alias("avg_frame_rate"), F.lit("0/0").alias("r_frame_rate"), F.lit(None).cast("string").alias("duration"),
    )
    streams = (
        F.when(F.col("p_partkey") % 17 == 0, F.array(audio))
        .when(F.col("p_partkey") % 3 == 0, F.array(video)).otherwise(F.array(audio, video))
    )
    fmt = F.struct(
        F.when(F.col("p_partkey") % 13 == 0, F.lit("N/A")).otherwise(F.col("p_retailprice").cast("string")).alias("duration")
    )
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("video_id"),
        F.to_json(F.struct(streams.alias("streams"), fmt.alias("format"))).alias("probe"),
    )


# DuckDB text of the same views.  WS_SQL is the same class of white space as on the Spark side.
WS_SQL = WS.replace("'", "''")

VIEWS: dict[str, str] = {
    "v_series": """SELECT user_id AS video_id, event_id AS ord,
        round_even((epoch_us(ts) - 1704067200000000) / 3600000::DOUBLE, 0) / 1000::DOUBLE AS t_sec, value AS level FROM events""",
    "v_frames": """SELECT label::BIGINT AS video_id, vec_id AS idx, vec_id / 10::DOUBLE AS t_sec,
        list_transform(embedding, lambda x: abs(x::DOUBLE)) AS hist FROM embeddings""",
    "v_segments": """SELECT conv_id AS video_id, turn + 1 AS id,
        turn * 20 + (conv_id % 7) * 0.5::DOUBLE AS start_sec,
        turn * 20 + (conv_id % 7) * 0.5::DOUBLE + 12 + length(text) % 17 AS end_sec, text,
        CASE length(text) % 7 WHEN 0 THEN 'Vui_Vẻ' WHEN 1 THEN 'EXCITED' WHEN 2 THEN 'calm-deep'
            WHEN 3 THEN 'neutral' WHEN 4 THEN 'Nghiêm túc' WHEN 5 THEN role END AS tone,
        CASE length(text) % 5 WHEN 0 THEN 'observed_fact' WHEN 1 THEN ' Safe_Inference ' WHEN 2 THEN 'creative_framing'
            WHEN 3 THEN 'user_provided_fact' ELSE 'guess' END AS certainty
        FROM conversations""",
    "v_words": f"""SELECT video_id, turn, k, word, turn * 20 + k * 0.35::DOUBLE AS w_start,
            turn * 20 + k * 0.35::DOUBLE + 0.3::DOUBLE AS w_end
        FROM (SELECT conv_id AS video_id, turn, unnest(toks) AS word, unnest(range(len(toks))) AS k
              FROM (SELECT *, list_filter(regexp_split_to_array(text, '{WS_SQL}+'), lambda x: x <> '') AS toks FROM conversations))
        WHERE k % 9 <> 8""",
    "v_candidates": """SELECT user_id AS video_id, event_id AS ord,
        round_even((epoch_us(ts) - 1704067200000000) / 3600000::DOUBLE, 0) / 1000::DOUBLE AS start_sec,
        round_even((epoch_us(ts) - 1704067200000000) / 3600000::DOUBLE, 0) / 1000::DOUBLE + value / 10::DOUBLE AS end_sec,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "v_ledger": """SELECT l_orderkey AS video_id, l_linenumber AS chunk_index,
        CAST(ceil(max(l_quantity) / 12.5::DOUBLE) AS INTEGER) AS n_stages FROM lineitem GROUP BY ALL""",
    "v_lines": """SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""",
    "v_formats": """SELECT l_orderkey AS video_id, CAST(l_quantity * 40 AS INTEGER) AS height,
        CASE l_returnflag WHEN 'A' THEN 'avc1' WHEN 'N' THEN 'av01' ELSE 'vp9' END AS codec,
        CASE l_linestatus WHEN 'O' THEN 'mp4' ELSE 'webm' END AS ext,
        l_linenumber AS format_no, l_partkey AS part_key, l_suppkey AS supp_key FROM lineitem""",
    "silences": """SELECT video_id, min(t_sec) AS start_sec, max(t_sec) AS end_sec
        FROM (SELECT *, sum(chg) OVER (PARTITION BY video_id ORDER BY t_sec, ord) AS run
              FROM (SELECT *, CASE WHEN (level < 50) IS DISTINCT FROM
                        lag(level < 50) OVER (PARTITION BY video_id ORDER BY t_sec, ord) THEN 1 ELSE 0 END AS chg FROM v_series))
        GROUP BY video_id, run HAVING any_value(level < 50) AND max(t_sec) - min(t_sec) >= 6""",
    "media": "SELECT video_id, max(t_sec) + 1 AS duration_sec FROM v_series GROUP BY video_id",
    "chunk_steps": """SELECT m.video_id, m.duration_sec AS dur, 0::DOUBLE AS start_sec, 0::DOUBLE AS end_sec, -1 AS chunk_index,
            '' AS cut_reason, coalesce(s.mids, []::DOUBLE[]) AS mids
          FROM media m LEFT JOIN (SELECT video_id, list((start_sec + end_sec) / 2 ORDER BY start_sec) AS mids
                                  FROM silences GROUP BY video_id) s USING (video_id)
        UNION ALL
        SELECT video_id, dur, end_sec,
            CASE WHEN last_one THEN dur ELSE greatest(end_sec + 60, least(coalesce(pick, end_sec + 240), dur)) END,
            chunk_index + 1, CASE WHEN last_one THEN 'final' WHEN pick IS NULL THEN 'hard' ELSE 'silence' END, mids
        FROM (SELECT *, CASE WHEN end_sec = 0 THEN dur <= 240 OR dur <= 360 ELSE dur - end_sec <= 360 END AS last_one,
                list_sort(list_transform(list_filter(mids, lambda m: m > end_sec + 60 AND m < dur AND abs(m - (end_sec + 240)) <= 45),
                    lambda m: {'d': abs(m - (end_sec + 240)), 't': m}))[1].t AS pick
              FROM chunk_steps WHERE cut_reason <> 'final' AND end_sec < dur - 1e-6)""",
    "chunks": "SELECT video_id, chunk_index, start_sec, end_sec, cut_reason FROM chunk_steps WHERE chunk_index >= 0",
}

DEPENDS = {
    "silences": ["v_series"], "media": ["v_series"], "chunk_steps": ["media", "silences"], "chunks": ["chunk_steps"],
}


def oracle(views: str, body: str, ctes: list[str] = ()) -> str:
    """DuckDB statement: the named views (with what they rest on), further CTEs, then the query."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in DEPENDS.get(name, []):
            need(dep)
        if name not in order:
            order.append(name)

    for name in views.split():
        need(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + list(ctes)
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    return head + body
