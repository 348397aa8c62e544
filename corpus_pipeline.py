"""A training corpus in five stages, from ``documents`` to packed sequences.

Each stage works on all that the one before it kept. ``run`` writes every stage as Parquet in the
session's shared folder and reads it again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callweft.llm.common import Scratch
from callweft.llm.decontaminate import decontaminate
from callweft.llm.jaccard_join import first_of_each
from callweft.llm.line_quality import apply_rules
from callweft.llm.packing import pack_documents
from callweft.llm.secrets import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines leave the others.

    Null and empty texts have no words and go, null ids and sources are keys of their own, repeated rows are judged each.
    """
    return apply_rules(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays (five-word shingles, similarity of 0.8 or more).

    The one of the least id, null ids last; of rows that repeat id and text one stays; texts without words all stay.
    """
    return first_of_each(docs, 5, 80, 100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null texts and items contain nothing and are contained nowhere."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; null texts stay null."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; a null text is one id, repeated rows are packed each."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL can't express the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives no rows, extra columns are carried along until packing."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)  # the table of the stage before; the input isn't one of scratch's
        docs = done
    return docs
