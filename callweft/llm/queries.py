"""Queries of the operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callweft.llm.chat_format import chat_digests, format_chats, with_probe
from callweft.llm.common import bound_batches
from callweft.llm.decontaminate import contained_items
from callweft.llm.fill_middle import fill_middle_digests
from callweft.llm.filter_audit import filter_audit
from callweft.llm.html_extract import extract_text
from callweft.llm.jaccard_join import jaccard_join
from callweft.llm.license_scan import license_scan
from callweft.llm.line_quality import quality_rules
from callweft.llm.oracles import SQL
from callweft.llm.packing import pack_documents
from callweft.llm.secrets import secret_scan
from callweft.llm.sentence_dedup import sentence_dedup
from callweft.llm.suffix_dedup import suffix_dedup
from callweft.llm.token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)  # whole texts go to Python workers
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(format_chats(with_probe(table(spark, sf_dir, "conversations"))))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_decontaminate, op2_secret_scan, op3_suffix_dedup, op4_html_extract, op5_license_scan, op6_sentence_dedup, op7_quality_rules, op8_packing, op9_token_counts, op10_jaccard_join, op11_filter_audit, op12_chat_format, op13_fill_middle)
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
