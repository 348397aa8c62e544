"""Audit of how filters act together: removals in every order, and each filter's exact Shapley share."""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweft.llm.common import text_of, words_of

FILTERS = "ABCDE"
CORNERS = range(1 << len(FILTERS))
#: Shares are integers after this scale: the number of orders.
SCALE = 120
MIN_WORDS = 200
MIN_DISTINCT_PCT = 50
MAX_CAPITALS_PCT = 3
SYMBOLS = "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def own_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_hash, mask) per row: the filters that a text fails by itself, bit i for the i-th letter."""
    t = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_of().alias("t")).withColumn("w", words_of(F.col("t")))
    n = F.size("w").cast("long")
    capitals = F.char_length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long")
    failed = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct("w")).cast("long") < MIN_DISTINCT_PCT * n,
        100 * capitals > MAX_CAPITALS_PCT * F.char_length("t").cast("long"),
        F.col("t").rlike(SYMBOLS),
    ]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(failed)), F.lit(0))
    return t.select("doc_id", "part", F.sha2("t", 256).alias("text_hash"), mask.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters that they fail.

    Rows of one text differ in part, labels and id only, so they are summed before they meet: a text that a third of
    all rows repeats is a handful of rows when the least id of its group is found.
    """
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    kind = ["text_hash", "part", "mask", "good", "toxic"]
    rows = own_failures(docs).join(marked, "doc_id", "left").groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    nameless = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0))
    groups = rows.groupBy(*kind).agg(F.sum("n").alias("n"), least.alias("least"), nameless.alias("nameless"))
    first = F.min("least.doc_id").over(Window.partitionBy("text_hash"))
    groups = groups.withColumn("passed", F.coalesce(F.when(F.col("least.doc_id") == first, F.col("least.n")), F.lit(0)) + F.col("nameless"))
    copied = F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("passed")).alias("n"))
    split = groups.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("passed").alias("n")), copied)).alias("s"))
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("s.n")).otherwise(0))
    return split.filter("s.n > 0").groupBy("part", F.col("s.mask").alias("mask")).agg(F.sum("s.n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def removal_polynomial(counts: dict[int, int]) -> list[int]:
    """Coefficients by set of filters of the multilinear extension of "documents removed" (``counts``: mask -> documents).

    With x_i the share of filter i that is applied, a document that fails the set M is removed by
    1 - prod over M of (1 - x_i); its monomials are the non-empty subsets of M with alternating signs.
    """
    out = [0] * len(CORNERS)
    for t in CORNERS[1:]:
        held = sum(n for mask, n in counts.items() if mask & t == t)
        out[t] = held if t.bit_count() % 2 else -held
    return out


def at_corner(polynomial: list[int], applied: int) -> int:
    """The polynomial where the filters of ``applied`` are on and the others off: the documents that they remove."""
    return sum(a for t, a in enumerate(polynomial) if t & applied == t)


def shapley_share(polynomial: list[int], i: int) -> int:
    """``SCALE`` times the integral of the derivative by x_i along the diagonal: each monomial of k filters gives a / k."""
    whole = SCALE * sum(Fraction(a, t.bit_count()) for t, a in enumerate(polynomial) if t >> i & 1)
    assert whole.denominator == 1
    return whole.numerator


def audit_rows(part: str, counts: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part, from at most 32 mask counts."""
    of = lambda c: {int(m): int(n) for m, n in zip(counts["mask"], counts[c], strict=True)}
    polynomials = {c: removal_polynomial(of(c)) for c in ("n", "good", "toxic")}
    gone = {c: [at_corner(p, s) for s in CORNERS] for c, p in polynomials.items()}
    share = [shapley_share(polynomials["n"], i) for i in range(len(FILTERS))]
    total, every = sum(of("n").values()), len(CORNERS) - 1
    rows = []
    for order in permutations(range(len(FILTERS))):
        before, name = 0, "".join(FILTERS[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            lost = {c: g[after] - g[before] for c, g in gone.items()}
            alone, only = gone["n"][1 << i], gone["n"][every] - gone["n"][every ^ 1 << i]
            rows.append((part, name, step, total - gone["n"][after], lost["n"], alone - lost["n"], only, lost["good"], lost["toxic"], share[i]))
            before = after
    return pd.DataFrame(rows, columns=["part", "filter_order", "step", *COUNTS])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: documents kept, removed, redundant, unique and lost, with Shapley shares.

    Failure conditions: A under 200 words; B fewer than half of the words distinct; C over 3 % capitals; D a symbol;
    E the text of a smaller doc_id. Null text is empty; null lang is the part ''; a null doc_id has no smaller one and
    is none, so such rows never fail E and make nobody fail it; repeated rows of one id count each and aren't copies of
    each other; labels that repeat an id count if one of them says so, null labels say nothing; no documents give no
    rows; other columns are ignored. The work up to ``mask_counts`` is Spark's; only at most 32 counts a part are left
    for the polynomials.
    """
    return mask_counts(docs, labels).groupBy("part").applyInPandas(lambda key, counts: audit_rows(key[0], counts), SCHEMA)
