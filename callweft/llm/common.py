"""Helpers shared by the operators: the shared folder, written intermediate tables, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a character class and as a run (fixed by the contracts).
SPACE = r"\x20\x09-\x0D"
SPACES = rf"[{SPACE}]+"
WORD_CHAR = rf"[^{SPACE}]"
#: Documents that a Python worker gets at a time; whole texts make the usual 10000 too large.
BATCH_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and the master is local (tests,
    a laptop) a temporary folder is made and set as the checkpoint folder; a cluster has to name one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="callweft-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Hand ``BATCH_ROWS`` rows to Python workers at a time, for the jobs that start inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bound_batches(spark: SparkSession) -> None:
    """Hand at most ``BATCH_ROWS`` rows to Python workers at a time, for jobs that start later in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Scratch:
    """Written intermediate tables of one operator call, in the shared folder.

    A written table cuts the lineage, so a lost executor never makes earlier work run again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/callweft/{name}-{uuid.uuid4().hex[:12]}"
        self.kept: list[tuple[DataFrame, str]] = []
        self.count = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read from its files."""
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *gone: DataFrame) -> None:
        """Delete the files of tables that ``keep`` returned and nobody reads any more."""
        for df, path in self.kept:
            if any(df is g for g in gone):
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.kept = [(df, path) for df, path in self.kept if not any(df is g for g in gone)]


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array."""
    return F.array_remove(F.split(text, SPACES), "")


def placed(items: Column, size, emit, kind: str, block: int = 256) -> Column:
    """What ``emit(at, item)`` (an array of SQL type ``kind``) gives for every item, at the sum of the sizes before it.

    Sizes are summed in blocks, so that arrays which grow stay short: linear in the number of items.
    """
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    state = lambda at, out: F.struct(at.cast("long").alias("at"), out.alias("out"))
    total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + size(x))
    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(p), F.lit(1)) - 1) / block).cast("int")), lambda i: F.slice(p, i * block + 1, block))

    def starts(b: Column) -> Column:
        begun = state(F.lit(0), F.array().cast("array<bigint>"))
        return F.aggregate(F.transform(b, total), begun, lambda s, n: state(s["at"] + n, F.concat(s["out"], F.array(s["at"]))), lambda s: s["out"])

    def inside(b: Column, at: Column) -> Column:
        step = lambda s, x: state(s["at"] + size(x), F.concat(s["out"], emit(s["at"], x)).cast(kind))
        return F.aggregate(b, state(at, F.array().cast(kind)), step, lambda s: s["out"])

    return once(items, lambda p: once(blocks(p), lambda b: F.flatten(F.zip_with(b, starts(b), inside))))


def same_row(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Join condition on keys that may be null."""
    out = F.lit(True)
    for key in keys:
        out = out & left[key].eqNullSafe(right[key])
    return out
