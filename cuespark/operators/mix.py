"""Gain envelopes and mixing over sampled levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import MixParams
from ..session import stage
from .ranges import attach, merge_ranges, neighbours
from .scan import Axis, Lead, RunSum, scan

KEY = "video_id"
INT16_FULL = 32768.0
BLOCK = 1 << 16  # samples of a track that are made together


def duck_ranges(voice: DataFrame, planned: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Measured voice ranges and planned ranges in one list (whole milliseconds), close ones joined."""
    in_ms = lambda df: df.select(KEY, *[F.rint(F.col(c) * 1000).cast("long").alias(n)
                                        for c, n in (("start_sec", "start_ms"), ("end_sec", "end_ms"))])
    both = in_ms(voice).unionByName(in_ms(planned))
    return merge_ranges(both, KEY, "start_ms", "end_ms", gap=params.merge_gap_ms, width=10_000.0)


def _ramp(t: Column, start: Column, end: Column, p: MixParams) -> Column:
    """Gain a single range asks for at ``t``."""
    depth = p.duck_ratio - 1.0
    ramp = float(max(p.ramp_ms, 1))
    return (
        F.when((t >= start) & (t < end), F.lit(p.duck_ratio))
        .when((t >= start - ramp) & (t < start), 1.0 + depth * (t - (start - ramp)) / ramp)
        .when((t >= end) & (t < end + ramp), p.duck_ratio - depth * (t - end) / ramp)
        .otherwise(F.lit(1.0))
    )


def duck_envelope(samples: DataFrame, ranges: DataFrame, params: MixParams = MixParams(), t: str = "t_sec") -> DataFrame:
    """Adds gain.  Ranges are disjoint, so of all ranges only the one before and the one after can set the lowest gain."""
    at = samples.withColumn("__ms", F.col(t) * 1000)
    found = neighbours(at, ranges, KEY, "__ms", "start_ms", ["start_ms", "end_ms"], width=10_000.0)
    side = lambda s: F.when(F.col(f"{s}_start_ms").isNotNull(), _ramp(F.col("__ms"), F.col(f"{s}_start_ms"), F.col(f"{s}_end_ms"), params))
    gain = F.least(F.coalesce(side("prev"), F.lit(1.0)), F.coalesce(side("next"), F.lit(1.0)))
    return found.withColumn("gain", gain).drop("__ms", "prev_start_ms", "prev_end_ms", "next_start_ms", "next_end_ms")


def duck_mix(bgm: DataFrame, voice: DataFrame, lengths: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Mixed samples per (video, sample_no): ``bgm`` has amplitude and gain, ``voice`` amplitude, ``lengths`` n samples.

    A quiet background is left out; a mix over the limit is scaled as a whole.  The track is cut or filled with silence to
    exactly n samples."""
    loud = bgm.groupBy(KEY).agg(F.sqrt(F.avg(F.col("amplitude") * F.col("amplitude"))).alias("rms"))
    audible = loud.select(KEY, (F.lit(20.0) * F.log10(F.col("rms") / INT16_FULL) >= params.silent_dbfs).alias("audible"))
    b = bgm.select(KEY, "sample_no", (F.col("amplitude") * F.col("gain")).alias("b"))
    v = voice.select(KEY, "sample_no", (F.col("amplitude") * F.lit(10.0 ** (params.voice_gain_db / 20.0))).alias("v"))
    both = b.join(v, [KEY, "sample_no"], "full")
    known = attach(_grid(lengths).join(both, [KEY, "sample_no"], "left"), audible, KEY)
    raw = F.when(F.coalesce("audible", F.lit(False)), F.coalesce("b", F.lit(0.0))).otherwise(0.0) + F.coalesce("v", F.lit(0.0))
    mixed = stage(known.select(KEY, "sample_no", raw.alias("mix")))
    limit = params.full_scale * params.limit_share
    peaks = mixed.groupBy(KEY).agg(F.max(F.abs("mix")).alias("peak"))
    scaled = F.when(F.col("peak") > limit, F.col("mix") * (F.lit(limit) / F.col("peak"))).otherwise(F.col("mix"))
    return attach(mixed, peaks, KEY, "inner").select(KEY, "sample_no", scaled.alias("mix"))


def _grid(lengths: DataFrame) -> DataFrame:
    """Sample numbers 0 .. n - 1 of every track, dealt out by blocks, so that a long track is made by many tasks."""
    blocks = lengths.filter("n > 0").select(KEY, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK).cast("long"))).alias("__block"))
    first = F.col("__block") * BLOCK
    return blocks.repartition(KEY, "__block").select(KEY, F.explode(F.sequence(first, F.least(first + BLOCK, F.col("n").cast("long")) - 1)).alias("sample_no"))


def chunk_samples(chunks: DataFrame, rate_ms: int) -> DataFrame:
    """Adds offset and n: the samples of each chunk (total_ms) on the grid of the whole track.

    Borders of chunks are rounded on the track, so what a chunk has beyond a whole step is not lost but carried on."""
    axis = Axis((KEY,), ("chunk_index",), F.floor(F.col("chunk_index") / 64).cast("long"))
    timed = scan(chunks, axis, RunSum("__before", "total_ms", inclusive=False))
    at = lambda ms: F.floor(ms / rate_ms).cast("long")
    return timed.withColumn("offset", at(F.col("__before"))).withColumn("n", at(F.col("__before") + F.col("total_ms")) - F.col("offset")).drop("__before")


def overlay_runs(clips: DataFrame, chunks: DataFrame, rate_ms: int) -> DataFrame:
    """Stretches of equal value [from_no, to_no) of each chunk's sum of clips, in the samples of ``chunk_samples``.

    A sweep over the ends of clips: each adds its amplitude at its first sample and takes it away behind its last, so the
    work goes with the clips, not with their length.  Amplitudes count to a billionth and add up exactly."""
    sized = chunks.filter("n > 0").select(KEY, "chunk_index", "n")
    sample = lambda c: F.ceil(F.col(c) / rate_ms).cast("long")
    inside = clips.join(sized, [KEY, "chunk_index"]).withColumns({
        "__a": F.greatest(sample("placed_start_ms"), F.lit(0)), "__b": F.least(sample("placed_end_ms"), F.col("n"))}).filter("__a < __b")
    change = F.col("amplitude").cast("decimal(28,9)")
    ends = inside.select(KEY, "chunk_index", F.inline(F.array(
        F.struct(F.col("__a").alias("from_no"), change.alias("change")), F.struct(F.col("__b").alias("from_no"), (-change).alias("change")))))
    border = F.struct(F.lit(0).cast("long").alias("from_no"), F.lit(0).cast("decimal(28,9)").alias("change"))
    borders = sized.select(KEY, "chunk_index", F.inline(F.array(border, border.withField("from_no", F.col("n")))))
    steps = ends.unionByName(borders).groupBy(KEY, "chunk_index", "from_no").agg(F.sum("change").alias("change"))
    axis = Axis((KEY, "chunk_index"), ("from_no",), F.floor(F.col("from_no") / BLOCK).cast("long"))
    runs = scan(steps, axis, RunSum("__sum", "change"), Lead("to_no", "from_no"))
    return runs.filter("to_no is not null").select(KEY, "chunk_index", "from_no", "to_no", F.col("__sum").cast("double").alias("value"))


def overlay(clips: DataFrame, chunks: DataFrame, rate_ms: int) -> DataFrame:
    """Sum of the clips on a silent grid per chunk (``clips``: video_id, chunk_index, placed_start_ms, placed_end_ms, amplitude;
    ``chunks``: video_id, chunk_index, total_ms).  A clip sounds at the grid points in [start, end)."""
    runs = overlay_runs(clips, chunk_samples(chunks, rate_ms), rate_ms)
    first, last = F.floor(F.col("from_no") / BLOCK), F.floor((F.col("to_no") - 1) / BLOCK)
    blocks = runs.select("*", F.explode(F.sequence(first, last)).alias("__block"))
    low, high = F.greatest("from_no", F.col("__block") * BLOCK), F.least("to_no", (F.col("__block") + 1) * BLOCK)
    return blocks.select(KEY, "chunk_index", F.explode(F.sequence(low, high - 1)).alias("sample_no"), "value")


def concat_chunks(samples: DataFrame, chunks: DataFrame, rate_ms: int) -> DataFrame:
    """Chunk samples moved to their place in the whole track, in chunk order."""
    offsets = chunk_samples(chunks, rate_ms).select(KEY, "chunk_index", "offset")
    return samples.join(offsets, [KEY, "chunk_index"]).select(KEY, (F.col("offset") + F.col("sample_no")).alias("sample_no"), "value")


def length_errors(samples: DataFrame, chunks: DataFrame, rate_ms: int) -> DataFrame:
    """Chunks whose samples do not fill their place in the track: expected and found numbers of different samples.

    Samples of a chunk that is not in ``chunks`` are an error of it, with none expected."""
    want = chunk_samples(chunks, rate_ms).select(KEY, "chunk_index", F.col("n").alias("expected"))
    have = samples.groupBy(KEY, "chunk_index").agg(F.countDistinct("sample_no").alias("found"))
    both = want.join(have, [KEY, "chunk_index"], "full").fillna(0, ["expected", "found"])
    return both.filter("expected <> found").select(KEY, "chunk_index", "expected", "found")
