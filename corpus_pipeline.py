"""Training corpus from raw documents: five stages, each a function of (spark, docs, sf_dir) that works on all it is given.

Documents that the quality classifier rejects go; of equal texts one stays; of each group of near duplicates (Jaccard
similarity of 0.8 or more of 5-word shingles) one stays; sources are mixed to tempered weights, by which documents of
small sources come up to twice; what is left is encoded.
All stages but the last return the columns of ``documents``, further columns of any name with them.

Odd rows: a null text counts as empty, and near dedup holds empty and blank texts for equal, so one stays if the classifier keeps
any.  Null sources and languages are values like others, and null labels or labels of no document teach nothing.  Rows that
repeat whole are judged one by one, the dedup stages keep one, and mixing shares the uses among those left.  Rows without an
id come after all others.  Of ties the smallest id stays.  Very long texts are read as a whole.  Empty tables give no rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cuespark.llm import bpe, exact_dedup, mixing, quality, similar
from cuespark.llm.common import staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text, host and path speak for quality, repeats of a row with it; all of them without any label."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: that with the smallest id."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: that with the smallest id."""
    return similar.drop_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once or twice, as the weight of its source says."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of tokens for each row."""
    return bpe.encode_texts(docs, public_tokenizers.path(bpe.VOCABULARY))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe encoding", encoding_stage),
]
#: No stage but exact dedup can be said in SQL; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded corpus: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids, a row for each use of a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
