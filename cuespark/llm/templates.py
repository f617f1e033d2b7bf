"""Line dedup (7) with a log-template tree.

A line is parsed to a leaf of a tree of fixed depth: first by its number of tokens, then by its leading tokens, where
tokens with digits or at-signs count as a variable field.  Within a leaf, the most frequent token of each position over
the leaf's different lines makes its template, and positions where a line differs are variable; a line belongs to it that
agrees on enough positions with the template and with the line of it that stays, that of the first document, as two
lines can match a template in different places and share little.  Any other line is a template of its own.  A template that occurs in two
or more documents is a repeated line: it stays in the document with the smallest id and is dropped from all others.

Counting happens on hashes of different lines, combined before the shuffle; tokens move only for leaves that hold several
lines of several documents.  The smallest and the largest document of a template tell whether it recurs, so no set of
documents is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from .common import attach, staged, text_key

LEADING = 4
#: Share of positions on which a line must agree with its leaf's template.
LEAST_AGREEMENT = 0.6
FIELD = "<*>"
_VARIABLE = r"(?<![^ ])[^ 0-9@]*+[0-9@][^ ]*+"


def parsed_lines(docs: DataFrame, id_col: str, text_col: str, leading: int = LEADING) -> DataFrame:
    """row_id, row_text, line_no, words (tokens with variable fields masked, joined by single spaces), line (their hash)
    and leaf of every line with a token.  Each step is a column of its own, so that none is computed twice."""
    flat = F.translate(F.col(text_col), "\t\x0b\x0c\r", "    ")
    d = docs.select(F.col(id_col).alias("row_id"), text_key(F.col(text_col)).alias("row_text"), F.posexplode(F.split(flat, "\n")).alias("line_no", "__line"))
    line = F.col("__line")
    d = once(d, {"__masked": F.when(line.rlike("[0-9@]"), F.regexp_replace(line, _VARIABLE, FIELD)).otherwise(line)}).drop("__line")
    masked = F.col("__masked")
    d = once(d, {"words": F.trim(F.when(masked.contains("  "), F.regexp_replace(masked, " {2,}", " ")).otherwise(masked))}).drop("__masked").filter("words <> ''")
    size = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit("")))
    return d.select("*", F.xxhash64("words").alias("line"), F.xxhash64(size, F.substring_index("words", " ", leading)).alias("leaf"))


def _document() -> Column:
    """Orders documents by id, null ids last."""
    return F.struct(F.col("row_id").isNull().alias("no_id"), F.col("row_id").alias("row_id"), F.col("row_text").alias("row_text"))


def generalised(rows: DataFrame, different: DataFrame, agreement: float) -> DataFrame:
    """(line, leaf) of the lines that belong to the template of their leaf."""
    leaves = different.groupBy("leaf").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n")).filter("n > 1 AND NOT first <=> last")
    some = staged(rows.select("leaf", "line", "words").join(leaves.select("leaf"), "leaf", "left_semi").dropDuplicates(["line", "leaf"]), "leaf-lines").withColumn("tokens", F.split("words", " ")).drop("words")
    counts = some.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count("*").alias("n"))
    modal = counts.groupBy("leaf", "at").agg(F.max_by("token", F.struct("n", "token")).alias("token"))
    modal = modal.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("template"))
    weights = some.groupBy("leaf").agg(F.count("*").alias("n"))
    joined = attach(some, staged(modal.join(weights, "leaf"), "templates"), "leaf", "n")
    alike = lambda other: F.size(F.filter(F.zip_with("tokens", other, lambda a, b: a == b), lambda x: x)) >= F.lit(agreement) * F.size("tokens")
    near = staged(joined.filter(alike("template")).select("leaf", "line", "tokens").join(different.select("leaf", "line", "first"), ["leaf", "line"]), "near-lines")
    # the template is a mixture: only lines that agree with the line which stays are the same line
    stays = near.groupBy("leaf").agg(F.min_by("tokens", F.struct("first", "line")).alias("stays"), F.count("*").alias("n"))
    return attach(near, staged(stays, "staying-lines"), "leaf", "n").filter(alike("stays")).select("line", "leaf")


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, leading: int = LEADING, agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """(row_id, row_text, line_no) of every line to drop."""
    rows = staged(parsed_lines(docs, id_col, text_col, leading), "lines")
    different = staged(rows.groupBy("line", "leaf").agg(F.min(_document()).alias("first"), F.max(_document()).alias("last"), F.count("*").alias("n")), "different-lines")
    members = generalised(rows, different, agreement).withColumn("member", F.lit(True))
    named = different.join(members, ["line", "leaf"], "left").withColumn("template", F.when(F.col("member"), F.struct(F.lit(True).alias("whole"), F.col("leaf").alias("id"))).otherwise(F.struct(F.lit(False).alias("whole"), F.col("line").alias("id"))))
    named = staged(named.select("line", "n", "first", "last", "template"), "named-lines")
    recurring = named.groupBy("template").agg(F.min("first").alias("keeper"), F.max("last").alias("other"), F.count("*").alias("lines")).filter("NOT keeper <=> other")
    facts = staged(attach(named.drop("first", "last"), staged(recurring.select("template", "keeper", "lines"), "recurring"), "template", "lines").select("line", "n", "keeper"), "line-facts")
    return attach(rows.drop("words"), facts, "line", "n").filter(~_document().eqNullSafe(F.col("keeper"))).select("row_id", "row_text", "line_no")


def _document_drops(docs: DataFrame, id_col: str, text_col: str, leading: int, agreement: float) -> DataFrame:
    drops = repeated_lines(docs, id_col, text_col, leading, agreement).distinct()
    return drops.groupBy(F.struct("row_id", "row_text").alias("doc")).agg(F.array_sort(F.collect_list("line_no")).alias("dropped"))


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leading: int = LEADING, agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped and dropped, the numbers of the lines to drop, from 0.

    Cases are as for ``dedup_lines``.  Texts are read and their lines compared, but whole texts do not move."""
    source = docs.select(F.struct(F.col(id_col).alias("row_id"), text_key(F.col(text_col)).alias("row_text")).alias("doc"),
                         F.coalesce(F.length(F.col(text_col)) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("bigint").alias("n_lines"))
    found = source.join(_document_drops(docs, id_col, text_col, leading, agreement), "doc", "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return found.select(F.col("doc.row_id").alias("doc_id"), "n_lines", F.size(dropped).cast("bigint").alias("n_dropped"), dropped.alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leading: int = LEADING, agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text (what stays) and text_sha256.

    Lines are what ``\\n`` separates; lines without a token stay.  Lines repeated within one document only stay.  Rows with
    equal id and text are one document, and both lose the same lines; rows without an id come after all others.  A null
    text counts as empty, with one line.  Other columns play no part; an empty table gives no rows.  Very long texts and
    lines are parsed whole."""
    drops = _document_drops(docs, id_col, text_col, leading, agreement).withColumnRenamed("dropped", "drops")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, gone, texts, shas = [], [], [], []
            for text, drop in zip(batch.column(1), batch.column(2), strict=True):
                lines, out = (text.as_py() or "").split("\n"), set(drop.as_py() or ())
                kept = "\n".join(x for i, x in enumerate(lines) if i not in out)
                totals.append(len(lines))
                gone.append(len(out))
                texts.append(kept)
                shas.append(hashlib.sha256(kept.encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string()), pa.array(shas, pa.string())],
                                             ["doc_id", "n_lines", "n_dropped", "text", "text_sha256"])

    source = docs.select(F.struct(F.col(id_col).alias("row_id"), text_key(F.col(text_col)).alias("row_text")).alias("doc"), F.col(text_col).alias("text"))
    joined = source.join(drops, "doc", "left").select(F.col("doc.row_id").alias("doc_id"), "text", "drops")
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(each, f"doc_id {kind}, n_lines bigint, n_dropped bigint, text string, text_sha256 string")
