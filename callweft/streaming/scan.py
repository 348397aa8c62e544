"""A stream over a folder of files that keeps a snapshot of the newest version of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LISTING = "path string, kind string, text string, mtime timestamp, size long"


def newest(rows: DataFrame) -> DataFrame:
    """The newest row of each path; the larger one of two with the same time."""
    w = Window.partitionBy("path").orderBy(F.col("mtime").desc(), F.col("size").desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def changes(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Versions (path, mtime, size) of a stream of listings, each once; late repeats beyond the watermark are dropped."""
    return stream.withWatermark("mtime", watermark).dropDuplicatesWithinWatermark(["path", "mtime", "size"])


def _buckets(spark: SparkSession, snapshot: str, below: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """(version, folder) of every bucket's versions, newest first, of batches that were written to the end."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{snapshot}/version=*/*")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    names = [(int(s.getPath().getParent().getName().partition("=")[2]), s.getPath().getName(), s.getPath().toString()) for s in found]
    done = {version for version, name, _ in names if name == "_SUCCESS" and (below is None or version < below)}
    out: dict[int, list[tuple[int, str]]] = {}
    for version, name, folder in sorted(names, reverse=True):
        if version in done and name.startswith("bucket="):
            out.setdefault(int(name.partition("=")[2]), []).append((version, folder))
    return out


def follow(
    spark: SparkSession, listings: str, snapshot: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64
) -> StreamingQuery:
    """Merge parquet listings that arrive in a folder into a snapshot in buckets of paths.

    ``parse`` turns new rows into facts rows; it must keep path, mtime and size. A batch writes a new version of the buckets
    that its paths fall in and of no others, so its work is that of its buckets, not of the snapshot. A batch that is
    retried after a failure reads what was before it and writes the same version again. Versions that a finished
    batch has replaced are deleted by the next one that has rows; a reader that is slower than a batch has to read again. A snapshot
    keeps its number of buckets. Returns the query, which stops when all present files are read.
    """
    stream = changes(spark.readStream.schema(LISTING).parquet(listings))
    bucketed = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = newest(batch)
        touched = [r.bucket for r in bucketed(fresh).select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        before = _buckets(session, snapshot, number)
        for versions in before.values():
            for _, folder in versions[1:]:
                gone = session._jvm.org.apache.hadoop.fs.Path(folder)
                gone.getFileSystem(session._jsc.hadoopConfiguration()).delete(gone, True)
        rows = bucketed(parse(fresh) if parse else fresh)
        stored = [before[b][0][1] for b in touched if b in before]
        if stored:
            old = session.read.option("basePath", snapshot).schema(rows.schema).parquet(*stored).drop("version")
            rows = newest(old.unionByName(rows))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{snapshot}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, snapshot: str) -> DataFrame:
    """The rows of the newest version of every bucket; an empty listing before the first batch."""
    newest_of = [versions[0][1] for versions in _buckets(spark, snapshot).values()]
    if not newest_of:
        return spark.createDataFrame([], LISTING)
    return spark.read.option("basePath", snapshot).parquet(*newest_of).drop("version", "bucket")
