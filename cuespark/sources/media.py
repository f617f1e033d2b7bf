"""Media probes and format lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBE_SCHEMA = (
    "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,"
    "r_frame_rate:string,duration:string>>,format:struct<duration:string>>"
)
DEFAULT_FPS = 25.0
# Hosts of the video site and of its short links.
SITE_HOSTS, SHORT_HOST = ("youtube.com", "www.youtube.com"), ("youtu.be", "www.youtu.be")


def fraction(c: Column) -> Column:
    """'30000/1001' or '25' as a number; null when it cannot be read or divides by zero."""
    parts = F.split(c, "/")
    num, den = parts[0].try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 1, num).when(F.size(parts) == 2, F.try_divide(num, F.nullif(den, F.lit(0.0))))


def media_catalog(probes: DataFrame, key: str = "video_id", probe: str = "probe") -> DataFrame:
    """One row per probe; ``reason`` tells why a row is no usable video (null when it is)."""
    p = probes.select(key, F.when(F.try_parse_json(probe).isNotNull(), F.from_json(probe, PROBE_SCHEMA)).alias("p"))
    video = F.get(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    p = p.select(key, "p", video.alias("v"))
    positive = lambda c: F.when(c.try_cast("double") > 0, c.try_cast("double"))
    duration = F.coalesce(positive(F.col("p.format.duration")), positive(F.col("v.duration")))
    rate = F.coalesce(F.nullif(F.col("v.avg_frame_rate"), F.lit("")), F.nullif(F.col("v.r_frame_rate"), F.lit("")), F.lit("0"))
    fps = fraction(rate)
    return p.select(
        key, duration.alias("duration_sec"), F.rint(duration * 1000).cast("long").alias("duration_ms"),
        F.coalesce(F.exists("p.streams", lambda s: s["codec_type"] == "audio"), F.lit(False)).alias("has_audio"),
        F.coalesce(F.col("v.width"), F.lit(0)).alias("width"), F.coalesce(F.col("v.height"), F.lit(0)).alias("height"),
        F.when(fps > 0, fps).otherwise(DEFAULT_FPS).alias("fps"), F.coalesce(F.col("v.codec_name"), F.lit("")).alias("codec"),
        F.when(F.col("p").isNull(), "unreadable probe").when(F.col("v").isNull(), "no video stream")
        .when(duration.isNull(), "no duration").alias("reason"),
    )


def split_reason(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their reason)."""
    return df.filter(F.col("reason").isNull()).drop("reason"), df.filter(F.col("reason").isNotNull())


def check_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Trimmed URL with ``reason`` null for a well-formed video link: a watch page whose first parameter is the video, a
    short video, or a short link, each with the name of a video."""
    u = F.trim(F.coalesce(F.col(url), F.lit("")))
    scheme, host = F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(u, F.lit("HOST")))
    path, query = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), F.lower(F.coalesce(F.try_parse_url(u, F.lit("QUERY")), F.lit("")))
    named = lambda c: c.rlike(r"^[A-Za-z0-9_-]")
    parts = F.split(path, "/")
    first, second = F.lower(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    watch = (first == "watch") & (F.size(parts) == 2) & query.startswith("v=") & named(F.substring(query, 3, 1))
    on_site = host.isin(*SITE_HOSTS) & (watch | ((first == "shorts") & named(second)))
    short = host.isin(*SHORT_HOST) & named(first)
    good = scheme.isin("http", "https") & (on_site | short)
    return df.withColumns({url: u, "reason": F.when(u == "", "empty").when(~F.coalesce(good, F.lit(False)), "not a video link")})


def pick_format(formats: DataFrame, cap: int, key: str = "video_id", tie_break: tuple[str, ...] = ()) -> DataFrame:
    """One format per video: best tier under the height cap, the tallest within it."""
    capped, mp4 = F.col("height") <= cap, F.col("ext") == "mp4"
    tier = F.when(capped & mp4, 1).when(capped, 2).otherwise(3)
    if cap <= 1080:
        tier = F.when(capped & mp4 & F.col("codec").startswith("avc1"), 0).otherwise(tier)
    rank = F.struct(tier.alias("tier"), (-F.col("height")).alias("neg"), *tie_break)
    picked = formats.groupBy(key).agg(F.min_by(F.struct(tier.alias("tier"), "height", "codec", "ext", *tie_break), rank).alias("f"))
    return picked.select(key, "f.*")
