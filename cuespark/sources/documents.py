"""Text documents, one per key, made of ordered lines, none gathered in memory while it is written.

They are kept packed, many documents to a file (``pack_documents``), and become files of their own only on request
(``write_documents``, ``export_documents``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage


def pack_documents(lines: DataFrame, path: str, key: str, order: list[str], line: str) -> None:
    """All documents as one table in the order of key and lines, in as many files as there are tasks.

    The range of keys and lines in every row group is the index, so ``read_lines`` of some keys reads only the groups
    that hold them.  A document longer than a file goes on in the next one.  The write is committed as a whole: a failed
    task leaves nothing that a reader sees."""
    rows = stage(lines.select(key, *order, line))  # the borders of the ranges come from a sample of it
    rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).write.mode("overwrite").parquet(path)


def read_lines(spark: SparkSession, path: str, key: str, keys: list | None = None) -> DataFrame:
    """The lines of packed documents with their key and order, of all or of the given keys."""
    rows = spark.read.parquet(path)
    return rows if keys is None else rows.filter(F.col(key).isin(keys))


def unpack_documents(spark: SparkSession, path: str, key: str, order: list[str], line: str, keys: list | None = None,
                     text: str = "document") -> DataFrame:
    """(key, text) of packed documents: the lines in order, each ended by a newline.  A text is one value, so use
    ``read_lines`` for documents that are too long for that."""
    row = F.struct(*order, F.concat(F.col(line), F.lit("\n")).alias("__line"))
    rows = read_lines(spark, path, key, keys).groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    return rows.select(key, F.array_join(F.transform("__rows", lambda r: r["__line"]), "").alias(text))


def export_documents(spark: SparkSession, path: str, target: str, key: str, order: list[str], line: str, keys: list | None = None) -> None:
    """Packed documents as a text file for each key below ``target``."""
    write_documents(read_lines(spark, path, key, keys), target, key, order, line)


def write_documents(lines: DataFrame, path: str, key: str, order: list[str], line: str) -> None:
    """One text file per key below ``path``, in a folder named by it, with the lines in ``order``.

    Rows are dealt by key and sorted within tasks, so the writer passes line after line to the file."""
    dealt = lines.repartition(key).sortWithinPartitions(key, *order)
    dealt.select(key, line).write.mode("overwrite").partitionBy(key).text(path)


def read_documents(spark: SparkSession, path: str, key: str, text: str = "document") -> DataFrame:
    """(key, text) of the files that ``write_documents`` left."""
    return spark.read.text(path, wholetext=True).select(key, "value").withColumnRenamed("value", text)
