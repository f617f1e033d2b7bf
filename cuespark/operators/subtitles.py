"""Subtitles: sentences, timed cues, word alignment and SRT documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS, tokens, wrap_two_lines
from ..functions.timecode import srt_timestamp
from ..session import stage
from ..sources.documents import pack_documents, unpack_documents, write_documents
from .ranges import asof, attach
from .scan import Axis, Lead, RowNumber, RunSum, Total, scan

KEY = "video_id"
SENTENCE_END = rf"(?<=[.!?…]){WS}+"


def sentences(segments: DataFrame) -> DataFrame:
    """video_id, id, seg_start, seg_end, pos, sentence for every non-blank sentence."""
    body = F.regexp_replace(F.col("text"), f"^{WS}+|{WS}+$", "")
    parts = F.filter(F.split(body, SENTENCE_END), lambda s: ~s.rlike(f"^{WS}*$"))
    return segments.select(KEY, "id", F.col("start_sec").alias("seg_start"), F.col("end_sec").alias("seg_end"), F.posexplode(parts).alias("pos", "sentence"))


def numbered_sentences(segments: DataFrame) -> DataFrame:
    """Sentences numbered over the whole video in order of their segments."""
    return scan(sentences(segments), Axis.time(KEY, ("seg_start", "id", "pos"), 60.0), RowNumber("sentence_no"))


def split_cues(segments: DataFrame, split: bool = True) -> DataFrame:
    """One cue per sentence; a segment's time is shared by character count and the last sentence takes the rest."""
    body = F.regexp_replace(F.col("text"), f"^{WS}+|{WS}+$", "")
    s = segments.select(KEY, "id", "start_sec", "end_sec", body.alias("text")).filter(F.col("text") != "")
    parts = F.filter(F.split("text", SENTENCE_END), lambda x: ~x.rlike(f"^{WS}*$")) if split else F.array("text")
    s = s.withColumn("parts", F.when(F.size(parts) > 1, parts).otherwise(F.array("text")))
    total = F.aggregate("parts", F.lit(0), lambda acc, x: acc + F.length(x))
    span = F.col("end_sec") - F.col("start_sec")
    out = "array<struct<pos:int,start_sec:double,end_sec:double,text:string>>"
    zero = F.struct(F.col("start_sec").alias("t"), F.array().cast(out).alias("out"))

    def step(acc, x):
        last = F.size(acc["out"]) == F.size("parts") - 1
        after = F.when(last, F.col("end_sec")).otherwise(acc["t"] + span * (F.length(x) / total))
        cue = F.struct(F.size(acc["out"]).alias("pos"), acc["t"].alias("start_sec"), F.least(after, F.col("end_sec")).alias("end_sec"), x.alias("text"))
        return F.struct(after.alias("t"), F.concat(acc["out"], F.array(cue)).alias("out"))

    cues = F.aggregate("parts", zero, step, lambda a: a["out"])
    return s.select(KEY, "id", F.col("start_sec").alias("seg_start"), F.inline(cues))


def cue_repair(cues: DataFrame, min_sec: float = 0.5) -> DataFrame:
    """Cues of at least ``min_sec`` that end no later than the next one starts."""
    wide = cues.withColumn("end_sec", F.when(F.col("end_sec") - F.col("start_sec") < min_sec, F.col("start_sec") + min_sec).otherwise(F.col("end_sec")))
    led = scan(wide, Axis.time(KEY, ("seg_start", "id", "pos"), 60.0), Lead("__next", "start_sec"), RowNumber("cue_no"))
    return led.withColumn("end_sec", F.when(F.col("__next") < F.col("end_sec"), F.col("__next")).otherwise(F.col("end_sec"))).drop("__next")


def align_words(numbered: DataFrame, words: DataFrame, word_order: tuple[str, ...], max_mismatch: float = 0.25) -> DataFrame:
    """Times of each sentence from timed words, by counting: sentence i takes the next max(1, tokens) words.

    ``numbered``: sentences with sentence_no; ``words``: video_id, w_start, w_end and the order columns.  All sentences of
    a video are rejected (accepted = false, no times) if it has no words or the counts differ too much."""
    s = numbered.withColumn("need", F.greatest(F.lit(1), F.size(tokens(F.col("sentence")))).cast("long"))
    by_no = Axis((KEY,), ("sentence_no",), F.floor(F.col("sentence_no") / 1000).cast("long"))
    s = stage(scan(s, by_no, RunSum("before", "need", inclusive=False), Total("expected", "need")))
    w = stage(scan(words, Axis.time(KEY, word_order, 60.0), RowNumber("word_no")))
    stats = w.groupBy(KEY).agg(F.count("*").alias("actual"), F.max_by("w_end", "word_no").alias("last_end"))
    marks = s.select(KEY, (F.col("before") + 1).alias("first_word"), "sentence_no", "need")
    owned = asof(w.select(KEY, "word_no", "w_start", "w_end"), marks, KEY, "word_no", "first_word", ["first_word", "sentence_no", "need"], width=2000.0)
    spans = owned.filter(F.col("word_no") < F.col("first_word") + F.col("need")).groupBy(KEY, "sentence_no").agg(
        F.min_by("w_start", "word_no").alias("a"), F.max_by("w_end", "word_no").alias("b"))
    known = attach(s, stats, KEY).join(spans, [KEY, "sentence_no"], "left")
    actual = F.coalesce("actual", F.lit(0))
    accepted = (actual > 0) & (F.abs(actual - F.col("expected")) / F.col("expected") <= max_mismatch)
    return known.withColumns({
        "accepted": accepted, "aligned_start": F.when(accepted, F.coalesce("a", "last_end")), "aligned_end": F.when(accepted, F.coalesce("b", "last_end"))
    }).drop("need", "before", "expected", "actual", "last_end", "a", "b")


def choose_cues(estimated: DataFrame, aligned: DataFrame) -> DataFrame:
    """Measured times for a video whose alignment was accepted and has one time per cue, the estimate otherwise."""
    n_est = estimated.groupBy(KEY).agg(F.count("*").alias("n_est"))
    n_ali = aligned.filter("accepted").groupBy(KEY).agg(F.count("*").alias("n_ali"))
    usable = n_est.join(n_ali, KEY).filter(F.col("n_est") == F.col("n_ali")).select(KEY, F.lit(True).alias("usable"))
    timed = estimated.join(aligned.select(KEY, "id", "pos", "aligned_start", "aligned_end"), [KEY, "id", "pos"], "left")
    flagged = attach(timed, usable, KEY)
    use = F.coalesce("usable", F.lit(False))
    return flagged.withColumns({
        "source": F.when(use, "aligned").otherwise("estimated"), "start_sec": F.when(use, F.col("aligned_start")).otherwise(F.col("start_sec")),
        "end_sec": F.when(use, F.col("aligned_end")).otherwise(F.col("end_sec"))}).drop("usable", "aligned_start", "aligned_end")


def srt_blocks(cues: DataFrame, max_chars: int = 42) -> DataFrame:
    """The block of each cue in an SRT document: number, times, one or two lines of text and an empty line."""
    block = F.concat(F.col("cue_no").cast("string"), F.lit("\n"), srt_timestamp(F.col("start_sec")), F.lit(" --> "), srt_timestamp(F.col("end_sec")),
                     F.lit("\n"), wrap_two_lines(F.col("text"), max_chars), F.lit("\n"))
    return cues.select(KEY, "cue_no", block.alias("block"))


def write_srt(cues: DataFrame, path: str, max_chars: int = 42) -> None:
    """One SRT file per video, whatever its length."""
    write_documents(srt_blocks(cues, max_chars), path, KEY, ["cue_no"], "block")


def pack_srt(cues: DataFrame, path: str, max_chars: int = 42) -> None:
    """The SRT documents of all videos, packed."""
    pack_documents(srt_blocks(cues, max_chars), path, KEY, ["cue_no"], "block")


def read_srt(spark: SparkSession, path: str, videos: list | None = None) -> DataFrame:
    """(video_id, srt) of packed SRT documents."""
    return unpack_documents(spark, path, KEY, ["cue_no"], "block", videos, "srt")
