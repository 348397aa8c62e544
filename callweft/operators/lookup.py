"""Name resolution as joins: ranked scopes, unique names, duplicate names, best overloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_lookup(requests: DataFrame, key: str, *scopes: DataFrame) -> DataFrame:
    """For every request the candidate of the first scope that has one (innermost scope first).

    Each scope is (key, target): a candidate for a request key. One aggregation picks by rank, so the
    scopes are never tried one after the other per row. Requests without a candidate are left out.
    """
    ranked = [s.select(key, F.lit(rank).alias("rank"), "target") for rank, s in enumerate(scopes, 1)]
    every = ranked[0]
    for scope in ranked[1:]:
        every = every.unionByName(scope)
    best = every.groupBy(key).agg(F.min(F.struct("rank", "target")).alias("best"))
    return requests.join(best, key).select(*requests.columns, F.col("best.rank").alias("rank"), F.col("best.target").alias("target"))


def unique_owner(declarations: DataFrame, names: list[str], owner: str) -> DataFrame:
    """Names that exactly one owner declares, with that owner."""
    return (
        declarations.groupBy(*names)
        .agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias(owner))
        .filter("owners = 1")
        .drop("owners")
    )


def bucket_preference(candidates: DataFrame, request: list[str], same: Column, default: Column) -> DataFrame:
    """Duplicate names: the only candidate of the same package, else the only default one, else all.

    ``candidates`` has a row per request and candidate; adds ``via`` (same, default, ambiguous).
    """
    w = Window.partitionBy(*request)
    counted = candidates.withColumn("_same", F.sum(same.cast("int")).over(w)).withColumn("_by_default", F.sum(default.cast("int")).over(w))
    via = F.when(F.col("_same") == 1, "same").when(F.col("_by_default") == 1, "default").otherwise("ambiguous")
    keep = ((F.col("via") == "same") & same) | ((F.col("via") == "default") & default) | (F.col("via") == "ambiguous")
    return counted.withColumn("via", via).filter(keep).drop("_same", "_by_default")


def bucket_choice(names: DataFrame, key: str, name: str, bucket: str, default: str) -> DataFrame:
    """(key, via, target, candidates): what each of several declarations of one name sees of the others.

    The rules of ``bucket_preference``, for every row as a caller: the only other one of its bucket, else the only
    other one of the default bucket, else all others, as their number. Counts and ends per bucket and per name
    answer it, so no pair of equal names is ever made, and a hot name is summed before it is shuffled.
    """
    ends = [F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last")]
    buckets = names.groupBy(name, bucket).agg(*ends)
    of_default = lambda c: F.when(F.col(bucket) == default, F.col(c))
    whole = buckets.groupBy(name).agg(F.sum("n").alias("total"), F.coalesce(F.sum(of_default("n")), F.lit(0)).alias("d"), F.min(of_default("first")).alias("d_first"), F.max(of_default("last")).alias("d_last"))
    rows = names.join(buckets, [name, bucket]).join(whole, name).filter("total > 1")
    other = lambda first, last: F.when(F.col(first) == F.col(key), F.col(last)).otherwise(F.col(first))
    same, by_default = F.col("n") == 2, F.col("d") - (F.col(bucket) == default).cast("int") == 1
    return rows.select(
        key,
        F.when(same, "same").when(by_default, "default").otherwise("ambiguous").alias("via"),
        F.when(same, other("first", "last")).when(by_default, other("d_first", "d_last")).alias("target"),
        F.when(same | by_default, 1).otherwise(F.col("total") - 1).cast("long").alias("candidates"),
    )


def best_match(pairs: DataFrame, request: list[str], score: Column, tie: str) -> DataFrame:
    """Per request the candidate with the highest score, the first by ``tie`` among equals."""
    rest = [c for c in pairs.columns if c not in request]
    scored = pairs.withColumn("score", score)
    best = F.max(F.struct(F.col("score"), (-F.col(tie)).alias("_first"), *[F.col(c) for c in rest])).alias("best")
    return scored.groupBy(*request).agg(best).select(*request, "best.score", *[f"best.{c}" for c in rest])


def best_number(pairs: DataFrame, request: list[str], score: Column, number: str, scores: range) -> DataFrame:
    """(request, score, number): ``best_match`` of candidates that are numbers, for scores of a few fixed values.

    The least candidate of each score is a number of fixed size, so pairs are hashed into one small row a request; the
    maximum of a struct would sort all of them, with all their columns.
    """
    least = [F.min(F.when(score == n, F.col(number))).alias(f"_{n}") for n in scores]
    found = pairs.groupBy(*request).agg(*least)
    best = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.struct(F.lit(n).alias("score"), F.col(f"_{n}").alias(number))) for n in reversed(scores)])
    return found.withColumn("_best", best).filter("_best is not null").select(*request, "_best.score", f"_best.{number}")


def overlap_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose arrays ``a`` and ``b`` share an element, joined on the elements rather than by trying all pairs."""
    one = left.withColumn("_e", F.explode(F.array_distinct(a)))
    two = right.withColumn("_e", F.explode(F.array_distinct(b)))
    return one.join(two, "_e").drop("_e").distinct()


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each row with the longest prefix of its text, null if none.

    A text is joined on its own beginnings of the lengths that occur among the prefixes, so this is an
    equi-join whatever the number of prefixes.
    """
    # As many lengths as the longest prefix has characters, at most.
    lengths = [r[0] for r in prefixes.select(F.length(prefix)).distinct().collect() if r[0]]
    sizes = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    begins = rows.select(text).distinct().select(text, F.explode(sizes).alias("_n")).filter(F.length(text) >= F.col("_n"))
    begins = begins.select(text, F.substring(F.col(text), F.lit(1), F.col("_n")).alias(prefix))
    hits = begins.join(prefixes, prefix)
    rest = [c for c in prefixes.columns if c != prefix]
    best = hits.groupBy(text).agg(F.max(F.struct(F.length(prefix).alias("_n"), prefix, *rest)).alias("_best"))
    return rows.join(best, text, "left").select(*rows.columns, f"_best.{prefix}", *[f"_best.{c}" for c in rest])


def evidence_before(rows: DataFrame, evidence: DataFrame, key: str, at: str, what: str) -> DataFrame:
    """Distinct rows with each distinct evidence of the same key that stands strictly before them.

    The first place of each value is all that counts, so repeated evidence is summed up before it is shuffled, and a row
    meets every value of its key once.
    """
    first = evidence.groupBy(F.col(key).alias("_k"), F.col(what).alias("evidence")).agg(F.min(at).alias("_at"))
    return rows.distinct().join(first, (F.col(key) == F.col("_k")) & (F.col("_at") < F.col(at))).select(*rows.columns, "evidence")


def last_before(rows: DataFrame, key: str, order: list[str], value: Column) -> Column:
    """The last non-null value of earlier rows of the key: the nearest declaration above a use."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(w)


def counted(rows: DataFrame, names: list[str]) -> DataFrame:
    """How many rows each name has."""
    return rows.groupBy(*names).agg(F.count("*").alias("n"))


def first_use(names: DataFrame, sites: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Names with the first site that has them (``order`` columns, null without one), for sorting by first appearance."""
    first = sites.groupBy(name).agg(F.min(F.struct(*order)).alias("_first"))
    return names.join(first, name, "left").select(*names.columns, *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order])
