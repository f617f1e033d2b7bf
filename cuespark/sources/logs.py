"""Log lines: silence markers, tails, and frame file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import Axis, Lag, RowNumber, scan
from ..session import stage

LINES_PER_SLAB = 10_000
START = r"silence_start:\s*(-?[0-9]+(?:\.[0-9]+)?)"
END = r"silence_end:\s*(-?[0-9]+(?:\.[0-9]+)?)\s*\|\s*silence_duration"
FRAME_NAME = r"frame_([0-9]+)_([0-9]+)\.jpg$"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, line) of text logs, read line by line and numbered from 0 over the pieces of a file, so that a log
    of any size is shared by many tasks."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    numbered = scan(stage(lines), Axis(("source",), ("piece", "place"), F.col("piece")), RowNumber("n"))
    return numbered.select("source", (F.col("n") - 1).alias("line_no"), "line")


def silence_markers(lines: DataFrame, line: str = "line") -> DataFrame:
    at = lambda p: F.regexp_extract(line, p, 1).try_cast("double")
    return lines.withColumns({"start_at": at(START), "end_at": at(END)}).filter(
        F.col("start_at").isNotNull() | F.col("end_at").isNotNull())


def silences_from_log(lines: DataFrame, source: str = "source", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """An end closes the marker before it if that is a start; a repeated start replaces the pending one."""
    marks = silence_markers(lines, line)
    axis = Axis((source,), (line_no,), F.floor(F.col(line_no) / LINES_PER_SLAB).cast("long"))
    paired = scan(marks, axis, Lag("opened_at", "start_at"))
    return paired.filter(F.col("end_at").isNotNull() & F.col("opened_at").isNotNull()).select(
        source, line_no, F.greatest(F.col("opened_at"), F.lit(0.0)).alias("start_sec"), F.col("end_at").alias("end_sec"))


def log_tail(logs: DataFrame, lines: DataFrame, n: int, source: str = "source", placeholder: str = "(no log lines)") -> DataFrame:
    """Last ``n`` lines per log in their order.  The rank limit is applied before the shuffle, so a huge log is cheap."""
    last = Window.partitionBy(source).orderBy(F.col("line_no").desc())
    tail = lines.withColumn("__r", F.row_number().over(last)).filter(F.col("__r") <= n).drop("__r")
    return logs.select(source).join(tail, source, "left").select(
        source, F.coalesce("line_no", F.lit(0)).alias("line_no"), F.coalesce("line", F.lit(placeholder)).alias("line"))


def list_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frame files of a folder tree; only their names are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.jpg").option("recursiveFileLookup", "true").load(folder)
    return parse_frame_names(files.select("path", "length"), "path")


def parse_frame_names(df: DataFrame, path: str) -> DataFrame:
    part = lambda i: F.regexp_extract(path, FRAME_NAME, i).try_cast("long")
    return df.withColumns({"frame_index": part(1), "timestamp_sec": part(2) / F.lit(1000.0)}).filter(F.col("frame_index").isNotNull())


