"""Incremental scans: what a snapshot already holds, what must be parsed, what has vanished."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweft.operators import lookup


def split_fresh(listing: DataFrame, snapshot: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that the snapshot holds unchanged, rows to parse), by equality of all key columns."""
    known = snapshot.select(*key).distinct()
    return listing.join(known, key, "left_semi"), listing.join(known, key, "left_anti")


def summary(listing: DataFrame, snapshot: DataFrame, key: list[str], path: str) -> DataFrame:
    """(kind, n): files to parse, files as the snapshot holds them, files that are gone, files without readable text."""
    cached, parse = split_fresh(listing, snapshot, key)
    parts = (("cached", cached), ("parsed", parse.filter("text is not null")), ("unreadable", parse.filter("text is null")), ("vanished", vanished(listing, snapshot, path)))
    named = [df.select(F.lit(kind).alias("kind")) for kind, df in parts]
    return lookup.counted(named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3]), ["kind"])


def vanished(listing: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """Snapshot rows whose key isn't listed any more."""
    return snapshot.join(listing.select(key).distinct(), key, "left_anti")
