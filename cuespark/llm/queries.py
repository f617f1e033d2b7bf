"""The registered queries opN_<name>: whole tables through the operators, and DuckDB statements where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, exact_dedup, langid, mixing, pages, quality, ranked, regions, rules, secrets, simhash, templates

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("op2_simhash_golay")
def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_exact_dedup", r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query("op5_bpe_speculate")
def op5_bpe_speculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.VOCABULARY), ids=False)


@query("op4_langid_ecoc")
def op4_langid_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_identify(table(spark, sf_dir, "documents"))


@query("op10_rule_lists")
def op10_rule_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.learn_and_judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_quality_bayes")
def op1_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_temperature_mix")
def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op7_line_templates")
def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.line_decisions(table(spark, sf_dir, "documents"))


@query("op6_page_differencing")
def op6_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_text(table(spark, sf_dir, "pages"))


@query("op13_ranked_search")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_conversation_tables")
def op11_conversation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit_damaged(table(spark, sf_dir, "conversations"))


@query("op12_jaccard_regions")
def op12_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.jaccard_components(table(spark, sf_dir, "documents"))
