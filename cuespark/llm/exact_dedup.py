"""Exact dedup (9): a persistent digest index, bucketed and sorted by digest, against which new documents are anti-joined.

The index is a Parquet table in a folder of the user's choice.  A batch of documents is reduced to one row per digest
before anything is compared (partial counts and minima before the shuffle, so a text with a third of all rows costs one
row per task), the digests that the index lacks are found by a sort-merge anti-join, for which only the batch is
shuffled, and these are appended as one sorted file per bucket.  Repeating a batch appends nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, keep_first, new_path, staged, text_key


def normal_text(text: Column) -> Column:
    """Each run of white space as one space; null as empty.  Single characters are exchanged first, so that the pattern
    only meets real runs."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.when(flat.contains("  "), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat)


class DigestIndex:
    """Digests seen so far with the id that stays for each: columns digest (SHA-256, binary) and keep_id.

    ``folder`` must be shared by all executors and may outlive the session: opening it again finds what was appended."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.folder = spark, folder
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.table = "digest_index_" + hashlib.md5(folder.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append_new(self, batch: DataFrame) -> None:
        """Appends (digest, keep_id) rows of distinct digests, leaving out those that are there."""
        fresh = batch.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").select("digest", "keep_id").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document, written once: row_no, row_id, row_text, digest."""
    sha = F.unhex(F.sha2(normal_text(F.col(text_col)).cast("binary"), 256))
    return staged(docs.select(
        F.col(id_col).alias("row_id"), text_key(F.col(text_col)).alias("row_text"), sha.alias("digest"),
        F.monotonically_increasing_id().alias("row_no")), "digests")


def find_copies(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Adds keep_id, group_size (rows of this batch with the digest) and kept to ``digest_rows``; the index grows.

    The row that stays is the one with the smallest id (null ids last), of repeated rows the first read; nothing of a
    text stays that the index had already, and keep_id then names the earlier document."""
    order = F.struct(F.col("row_id").isNull().alias("n"), F.col("row_id").alias("row_id"), F.col("row_no").alias("row_no"))
    groups = staged(rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("group_size")).select(
        "digest", F.col("first.row_id").alias("keep_id"), F.col("first.row_no").alias("keep_no"), "group_size"), "groups")
    known = index.read().select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
    facts = staged(groups.hint("merge").join(known, "digest", "left").select(
        "digest", F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(F.col("old").isNull(), F.col("keep_no")).alias("keep_no"), "group_size"), "verdicts")
    index.append_new(groups.select("digest", "keep_id"))
    return attach(rows, facts, "digest", "group_size").select(
        "row_id", "row_text", "keep_id", "group_size", (F.coalesce(F.col("row_no") == F.col("keep_no"), F.lit(False))).alias("kept"), "digest")


def mark_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of ``[\\x20\\x09-\\x0D]`` becomes one space.  Null and empty texts are
    equal to each other.  Repeated (id, text) rows are all returned and one of them is kept.  Without an index an empty
    one is made, so that the table is judged by itself.  Other columns play no part; an empty table gives no rows."""
    index = index or DigestIndex(docs.sparkSession, new_path(docs.sparkSession, "digest-index"), docs.schema[id_col].dataType.simpleString())
    found = find_copies(digest_rows(docs, id_col, text_col), index)
    return found.select(F.col("row_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, for the same cases as ``mark_copies``."""
    index = index or DigestIndex(docs.sparkSession, new_path(docs.sparkSession, "digest-index"), docs.schema[id_col].dataType.simpleString())
    rows = digest_rows(docs, id_col, text_col)
    kept = find_copies(rows, index).filter("kept")
    return keep_first(docs, rows, kept, {"row_id": F.col(id_col), "row_text": text_key(F.col(text_col))})
