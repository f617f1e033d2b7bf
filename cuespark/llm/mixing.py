"""Mixing sources to target weights (3) by temperature.

A source's weight is its share of tokens to the power of an exponent between zero (all equal) and one (as found).  The
exponent is the largest that lets the entropy of the weights reach its target, or, if that would repeat some source too
often, the smallest that keeps to the limit of repetition.  Both are found by section: each pass evaluates a row of
exponents in one aggregation over the table of sources and keeps the interval in which the bound is crossed.

The weights are realised as token quotas.  A source is cut into blocks of documents by a hash; in each epoch its blocks
are dealt in an order of their own, and the documents within a block too; the last epoch ends where the quota does.  A
block is of bounded size, and the order of blocks is summed up over slabs of blocks, so that no task meets a whole source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, attach, repeat_rows, staged, text_key

#: Share of the greatest possible entropy that weights should reach, and how often a document may be used.
TARGET_ENTROPY, MAX_REPEATS = 0.97, 2.0
BLOCK_TOKENS, SLAB_BLOCKS, SEED = 1_000_000, 4096, 20
#: Documents of a block at most, on average: those without words count for no tokens.
BLOCK_ROWS = 100_000
SECTIONS, PASSES = 32, 7


@dataclass(frozen=True)
class Temperature:
    """Exponent with the entropy of its weights (share of the greatest) and the epochs of the smallest source."""

    exponent: float
    entropy: float
    repeats: float
    budget: float


def token_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row_id, row_text, source (a struct, so that null is a source) and tokens, which are words, written once."""
    return staged(docs.select(
        F.col(id_col).alias("row_id"), text_key(F.col(text_col)).alias("row_text"), F.struct(F.col(source_col).alias("name")).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("tokens")), "tokens")


def source_totals(rows: DataFrame) -> DataFrame:
    return staged(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")), "sources")


def find_temperature(
        sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> Temperature:
    """The exponent for sources (tokens); sources without tokens have no weight.

    Without ``budget`` it is the fewest tokens with which every document is used at least once."""
    live = sources.filter("tokens > 0")
    total, n, least, most = live.agg(F.sum("tokens"), F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return Temperature(1.0, 1.0, 1.0, 0.0)
    share = F.col("tokens") / F.lit(float(total))

    def measure(exponents: list[float]) -> list[Temperature]:
        power = F.pow("share", "t")
        tried = live.select(share.alias("share"), F.explode(F.array(*map(F.lit, exponents))).alias("t"))
        got = {r.t: r for r in tried.groupBy("t").agg(F.sum(power).alias("z"), F.sum(power * F.ln("share")).alias("a")).collect()}
        out = []
        for t in exponents:
            z, a = got[t].z, got[t].a
            spent = budget if budget is not None else total * z * (most / total) ** (1 - t)
            out.append(Temperature(t, (math.log(z) - t * a / z) / math.log(n) if n > 1 else 1.0, spent / total * (least / total) ** (t - 1) / z, spent))
        return out

    def section(good_low: bool, good) -> Temperature:
        """The last good exponent from the low end, or the first one towards the high end."""
        low, high = measure([0.0, 1.0])
        if good(high) and good(low):
            return high if good_low else low
        if not good(low if good_low else high):
            return low if good_low else high
        for _ in range(PASSES):
            steps = measure([low.exponent + (high.exponent - low.exponent) * i / SECTIONS for i in range(1, SECTIONS)])
            points = [low, *steps, high]
            at = max(i for i, p in enumerate(points) if good(p)) if good_low else min(i for i, p in enumerate(points) if good(p)) - 1
            low, high = points[at], points[at + 1]
        return low if good_low else high

    mixed = section(True, lambda p: p.entropy >= target_entropy)
    if mixed.repeats <= max_repeats:
        return mixed
    return section(False, lambda p: p.repeats <= max_repeats)


def _unit(*columns: Column | str) -> Column:
    """A number in [0, 1) drawn by hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def deal(rows: DataFrame, sources: DataFrame, temperature: Temperature, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """row_id, row_text, source, tokens, epoch, block and position (0 to 1, the order of the mixture) of each use of a document."""
    live = sources.filter("tokens > 0")
    total, z = live.agg(F.sum("tokens"), F.sum(F.pow("tokens", F.lit(temperature.exponent)))).first()
    quota = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(temperature.exponent)) / F.lit(z or 1.0) * temperature.budget).otherwise(0.0)
    near = F.round(quota / F.col("tokens"))  # a quota of whole epochs, but for rounding, is that many
    epochs = F.when(F.col("tokens") == 0, 1.0).when(F.abs(quota / F.col("tokens") - near) < 1e-7, near).otherwise(quota / F.col("tokens"))
    facts = staged(sources.select(
        "source", "documents", F.col("tokens").alias("source_tokens"), epochs.alias("epochs"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens), F.ceil(F.col("documents") / BLOCK_ROWS)).alias("blocks")), "source-facts")
    block = F.floor(_unit(F.lit(seed), "row_id", "row_text") * F.col("blocks"))
    uses = attach(rows, facts, "source", "documents").withColumn("block", block).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs") - 1, F.lit(0)).cast("int")))).filter("epochs > 0")

    slabs = F.ceil(F.col("blocks") / SLAB_BLOCKS)
    sizes = uses.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("size"), F.first("blocks").alias("blocks"), F.count("*").alias("n"))
    sizes = staged(sizes.withColumn("at", _unit(F.lit(seed + 1), "source", "epoch", "block")).withColumn("slab", F.floor(F.col("at") * slabs)), "blocks")
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slab_starts = sizes.groupBy("source", "epoch", "slab").agg(F.sum("size").alias("size")).select(
        "source", "epoch", "slab", before(Window.partitionBy("source", "epoch").orderBy("slab")).alias("slab_start"))
    starts = sizes.withColumn("in_slab", before(Window.partitionBy("source", "epoch", "slab").orderBy("at", "block"))).join(
        slab_starts, ["source", "epoch", "slab"]).select("source", "epoch", "block", (F.col("slab_start") + F.col("in_slab")).alias("block_start"))
    order = Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64(F.lit(seed + 2), "epoch", "row_id", "row_text"), "row_id", "row_text")
    inner = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = uses.withColumn("inner", inner).join(starts, ["source", "epoch", "block"])
    start = F.col("block_start") + F.col("inner")
    whole = F.col("epochs") * F.col("source_tokens")
    used = (F.col("epoch") + 1 <= F.col("epochs")) | (F.col("epoch") * F.col("source_tokens") + start < whole)
    position = F.when(whole > 0, (F.col("epoch") * F.col("source_tokens") + start) / whole).otherwise(_unit(F.lit(seed), "row_id", "row_text"))
    return dealt.filter(used).select("row_id", "row_text", "source", "tokens", "epoch", F.col("block").cast("bigint").alias("block"), position.alias("position"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float = TARGET_ENTROPY,
        max_repeats: float = MAX_REPEATS, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """One row per use of a document: doc_id, source, tokens, epoch, block, position.

    Reading in the order of ``position`` (then doc_id), every stretch holds the sources by their weights.  Without a budget
    every document is used once at least.  A null source is a source; null and empty texts have no tokens, and a source
    without any is used once.  Repeated rows are dealt like others.  Null ids stay null; other columns play no part; an
    empty table gives no rows."""
    rows = token_rows(docs, id_col, text_col, source_col)
    sources = source_totals(rows)
    dealt = deal(rows, sources, find_temperature(sources, target_entropy, max_repeats, budget), block_tokens, seed)
    return dealt.select(F.col("row_id").alias("doc_id"), F.col("source.name").alias("source"), "tokens", "epoch", "block", "position")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents with all their columns, each as often as the mixture uses it."""
    rows = token_rows(docs, id_col, text_col, source_col)
    sources = source_totals(rows)
    temperature = find_temperature(sources, **{k: v for k, v in options.items() if k in ("target_entropy", "max_repeats", "budget")})
    dealt = deal(rows, sources, temperature, **{k: v for k, v in options.items() if k in ("block_tokens", "seed")})
    uses = dealt.groupBy("row_id", "row_text", F.col("source.name").alias("source")).agg(F.count("*").cast("int").alias("copies"))
    return repeat_rows(docs, uses, {"row_id": F.col(id_col), "row_text": text_key(F.col(text_col)), "source": F.col(source_col)})
