"""Script documents in JSON: reading them into raw rows, and writing scripts and subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecode import format_timestamp
from ..operators.scan import Axis, RowNumber, scan

RAW_FIELDS = ("id", "start_time", "start", "end_time", "end", "text", "tone", "emotion", "certainty")
RAW_SCHEMA = "struct<" + ",".join(f"`{f}`:string" for f in RAW_FIELDS) + ">"


SCRIPT_FIELDS = "id long, start_time string, end_time string, duration_sec double, text string, tone string, certainty string"


def read_script_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("doc"))


def document_array(doc: Column) -> Column:
    """The array a document holds: itself, or the first list-valued field of an object; null if there is none.

    What a field is, is read from the parsed document; a text that looks like a list is a text."""
    body = F.regexp_replace(doc, r"(?U)^\s+|\s+$", "")
    whole = F.try_parse_json(body)
    kind = F.schema_of_variant(whole)
    fields = F.when(kind.startswith("OBJECT"), whole.cast("map<string, variant>"))
    raw = F.from_json(F.when(kind.startswith("OBJECT"), body), "map<string, string>")
    listed = F.filter(F.json_object_keys(body), lambda k: F.schema_of_variant(fields[k]).startswith("ARRAY"))
    return F.from_json(F.when(kind.startswith("ARRAY"), body).otherwise(raw[F.get(listed, F.lit(0))]), "array<string>")


def script_rows(docs: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(raw rows with their position, documents that hold no array)."""
    parsed = docs.withColumn("__rows", document_array(F.col(doc)))
    kept = [c for c in docs.columns if c != doc]
    rows = parsed.select(*kept, F.posexplode("__rows").alias("pos", "raw"))
    rejects = parsed.filter(F.col("__rows").isNull()).select(*kept, F.lit("no array of rows").alias("reason"))
    return rows, rejects


def numbered_script(segments: DataFrame, key: str = "video_id", chunk: str = "chunk_index") -> DataFrame:
    """Script rows as they are written: clock times, duration, ids 1..n over (chunk, start)."""
    axis = Axis((key,), (chunk, "start_sec", "id"), F.col(chunk).cast("long"))
    numbered = scan(segments, axis, RowNumber("number"))
    return numbered.select(
        key, chunk, F.col("number").cast("long").alias("id"), format_timestamp(F.col("start_sec")).alias("start_time"),
        format_timestamp(F.col("end_sec")).alias("end_time"),
        (F.rint((F.col("end_sec") - F.col("start_sec")) * 1000) / 1000.0).alias("duration_sec"), "text", "tone", "certainty")


def write_script(rows: DataFrame, path: str, key: str = "video_id", by_video: bool = False) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(key) if by_video else writer).json(path)


def read_script(spark: SparkSession, path: str, key: str = "video_id", chunk: str = "chunk_index") -> DataFrame:
    """The rows that ``write_script`` left."""
    return spark.read.schema(f"`{key}` long, `{chunk}` int, {SCRIPT_FIELDS}").json(path)
