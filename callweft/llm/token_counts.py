"""Exact length histogram: totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweft.llm.common import Scratch
from callweft.llm.tokens import VOCABULARY, encode

#: Lengths per block of the two-level suffix sums.
BLOCK = 1024


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens) per document row; a null text has 0 tokens."""

    @F.pandas_udf("long")
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([len(encode(t, vocabulary)) for t in texts], dtype="int64")

    return docs.select(length("text").alias("n_tokens"))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """Answers at every observed length L, as a context limit.

    context_limit, n_docs (of this length), docs_over (longer), tokens_over (tokens of longer ones),
    tokens_total, tokens_kept (each document cut at L), docs_total, quantile (share of documents
    that fit). Suffix sums run inside blocks of lengths; block totals, of which there are as many as
    the longest length has blocks, are summed apart and joined.
    """
    block = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    longer = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = block.select(
        "block",
        "n_tokens",
        "n_docs",
        F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("docs_in"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(longer), F.lit(0)).alias("tokens_in"),
    )
    totals = block.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = totals.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(every).alias("docs_total"),
        F.sum("t").over(every).alias("tokens_total"),
    )
    over = F.col("docs_in") + F.col("docs_above")
    tokens_over = F.col("tokens_in") + F.col("tokens_above")
    return inside.join(blocks, "block").select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        over.alias("docs_over"),
        tokens_over.alias("tokens_over"),
        "docs_total",
        "tokens_total",
        (F.col("tokens_total") - tokens_over + over * F.col("n_tokens")).alias("tokens_kept"),
        ((F.col("docs_total") - over) / F.col("docs_total")).alias("quantile"),
    )


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The limit table of all documents.

    Null and empty texts count as length 0; repeated rows count each; an empty table gives no rows;
    other columns are ignored.
    """
    # Written, since the table reads it twice: as few rows as there are lengths, while encoding is the work.
    histogram = Scratch(docs.sparkSession, "lengths").keep(length_histogram(token_lengths(docs, vocabulary)), "histogram")
    return limit_table(histogram)


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """Kept tokens and fitting documents for any limits (column ``context_limit``), observed or not.

    A limit joins the histogram as a length of no documents, and the suffix sums answer it like any other.
    """
    asked = limits.select(F.col("context_limit").cast("long").alias("n_tokens")).distinct()
    both = histogram.unionByName(asked.withColumn("n_docs", F.lit(0).cast("long"))).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    table = limit_table(both).join(asked.withColumnRenamed("n_tokens", "context_limit"), "context_limit")
    return table.select("context_limit", (F.col("docs_total") - F.col("docs_over")).alias("docs_fitting"), "tokens_kept")


def length_quantile(table: DataFrame, q: float) -> DataFrame:
    """The smallest observed length at which a share ``q`` of the documents fits."""
    return table.filter(F.col("quantile") >= q).agg(F.min("context_limit").alias("n_tokens"))
