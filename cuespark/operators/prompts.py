"""Request texts for models beyond the batch prompts of ``planning.prompt_table``: own short templates, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecode import format_timestamp
from .planning import batch_fixed, sparse_pick
from .ranges import attach, overlapping

KEY = "video_id"


def _listing(samples: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Per group its lines ``Image n: time`` in order, with the first and last time."""
    line = F.concat(F.lit("Image "), F.col("__n").cast("string"), F.lit(": "), format_timestamp(F.col("t_sec")))
    numbered = samples.withColumn("__n", F.expr(number))
    return numbered.groupBy(*keys).agg(
        F.min("t_sec").alias("t0"), F.max("t_sec").alias("t1"), F.count("*").alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("images"))


def outline_requests(samples: DataFrame, duration: str = "duration_sec", media: DataFrame | None = None, most: int = 10) -> DataFrame:
    """One request per video for an outline of the whole, from at most ``most`` images spread over it."""
    picked = sparse_pick(samples, most).withColumn("row_no", F.col("row_no").cast("long"))
    rows = _listing(picked, [KEY], f"floor((row_no - 1) / greatest(1, floor(n / least(n, {most})))) + 1")
    end = F.col("t1") if media is None else F.col(duration)
    rows = rows if media is None else attach(rows, media.select(KEY, duration), KEY)
    text = F.concat_ws("\n", F.lit("Outline the whole video in order."), F.col("images"), F.concat(F.lit("Length: "), format_timestamp(end)),
                       F.lit("Answer with a JSON array of parts: start_time, end_time, summary."))
    return rows.select(KEY, "n", text.alias("prompt"))


def highlight_requests(samples: DataFrame, per_batch: int) -> DataFrame:
    """One request per batch of images to find and score moments worth keeping."""
    rows = _listing(batch_fixed(samples, per_batch), [KEY, "batch"], f"(row_no - 1) % {per_batch} + 1")
    text = F.concat_ws("\n", F.lit("Find the moments worth keeping."), F.col("images"),
                       F.concat(F.lit("Range: "), format_timestamp(F.col("t0")), F.lit(" - "), format_timestamp(F.col("t1"))),
                       F.lit("Answer with a JSON array: start_time, end_time, score from 1 to 10."))
    return rows.select(KEY, "batch", "n", text.alias("prompt"))


def _span(t0: Column, t1: Column) -> Column:
    return F.concat(format_timestamp(t0), F.lit(" - "), format_timestamp(t1))


def _word_cap(t0: Column, t1: Column, words_per_sec: float) -> Column:
    cap = F.greatest(F.lit(1), F.floor((t1 - t0) * words_per_sec).cast("int"))
    return F.concat(F.lit("At most "), cap.cast("string"), F.lit(" words."))


def continuous_requests(samples: DataFrame, per_batch: int, words_per_sec: float) -> DataFrame:
    """One request per batch of images for a single flowing paragraph over the whole batch; t0 and t1 are its range.

    The answer has one element with exactly this range, so the steps after it treat it as any segment."""
    rows = _listing(batch_fixed(samples, per_batch), [KEY, "batch"], f"(row_no - 1) % {per_batch} + 1")
    t0, t1 = F.col("t0"), F.col("t1")
    text = F.concat_ws("\n", F.lit("Write one flowing paragraph over all images, with full punctuation."), F.col("images"),
                       F.concat(F.lit("Range: "), _span(t0, t1)), _word_cap(t0, t1, words_per_sec),
                       F.lit("Answer with a JSON array of one element that has just this range: start_time, end_time, text, tone, certainty."))
    return rows.select(KEY, "batch", "n", "t0", "t1", text.alias("prompt"))


def link_requests(chunks: DataFrame, words_per_sec: float, url: str = "url") -> DataFrame:
    """One request per chunk of a video that the model watches by its link (``chunks``: video_id, chunk_index, start_sec,
    end_sec and the link).  The range is that of the whole chunk, no images go along; without a link there is no request."""
    t0, t1 = F.col("start_sec"), F.col("end_sec")
    text = F.concat_ws("\n", F.concat(F.lit("Watch "), F.col(url)), F.concat(F.lit("Narrate all of "), _span(t0, t1)), _word_cap(t0, t1, words_per_sec),
                       F.when(F.col("chunk_index") == 0, F.lit("Open with a hook.")).otherwise(F.lit("Continue the story.")),
                       F.lit("Answer with a JSON array: start_time, end_time, text, tone, certainty."))
    return chunks.filter(F.coalesce(F.col(url), F.lit("")) != "").select(KEY, "chunk_index", text.alias("prompt"))


def with_outline(prompts: DataFrame, outline: DataFrame, part: str = "batch") -> DataFrame:
    """Adds to each prompt (with its range t0, t1) the parts of the outline that overlap it, in order of time (``outline``:
    video_id, start_sec, end_sec, summary); blank summaries are left out, and a prompt without parts stays as it is."""
    given = outline.filter(F.coalesce(F.trim("summary"), F.lit("")) != "").select(
        KEY, F.col("start_sec").alias("o_start"), F.col("end_sec").alias("o_end"), "summary")
    meets = (F.col("o_start") < F.col("t1")) & (F.col("o_end") > F.col("t0"))
    pairs = overlapping(prompts.select(KEY, part, "t0", "t1"), given, KEY, ("t0", "t1"), ("o_start", "o_end"), meets)
    line = F.concat(_span(F.col("o_start"), F.col("o_end")), F.lit(": "), F.col("summary")).alias("line")
    lines = pairs.groupBy(KEY, part).agg(F.array_sort(F.collect_list(F.struct("o_start", "o_end", "summary", line))).alias("__parts"))
    joined = prompts.join(lines, [KEY, part], "left")
    shown = F.when(F.col("__parts").isNotNull(), F.concat(F.lit("Outline here:\n"), F.array_join(F.transform("__parts", lambda p: p["line"]), "\n")))
    return joined.withColumn("prompt", F.concat_ws("\n", "prompt", shown)).drop("__parts")


def rewrite_requests(budgeted: DataFrame) -> DataFrame:
    """One request for each line over its budget (the columns of ``segments.word_budget``)."""
    text = F.concat_ws("\n", F.concat(F.lit("Shorten to at most "), F.col("max_words").cast("string"), F.lit(" words, same language and meaning.")),
                       F.concat(F.lit("Line "), F.col("id").cast("string"), F.lit(": "), F.col("text")), F.lit("Answer with a JSON array: id, text."))
    return budgeted.filter("over_budget").select(KEY, "id", "max_words", text.alias("prompt"))


def with_story(prompts: DataFrame, context: DataFrame, hooks: DataFrame | None = None, certainty_rule: bool = True) -> DataFrame:
    """Adds to batch prompts the lines before the batch (``context``: video_id, batch, context), the hook of the story
    (``hooks``: video_id, hook) and the rule on what may be stated as fact."""
    joined = prompts.join(context.select(KEY, "batch", "context"), [KEY, "batch"], "left")
    joined = joined.withColumn("hook", F.lit(None).cast("string")) if hooks is None else attach(joined, hooks.select(KEY, "hook"), KEY)
    shown = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(title), c))
    rule = [F.lit("State only what is seen; mark the rest as an inference or as framing.")] if certainty_rule else []
    text = F.concat_ws("\n", shown("The story opened with: ", F.col("hook")), shown("Before:\n", F.col("context")), "prompt", *rule)
    return joined.withColumn("prompt", text).drop("context", "hook")
