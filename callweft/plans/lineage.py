"""Cutting the lineage of iterative plans in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=8)
def shared_folder(spark: SparkSession) -> str:
    """A folder of this run in the session's ``spark.checkpoint.dir``, deleted when the process ends.

    Only where none is set and the master is local (tests, a laptop) it lies in a temporary folder; a cluster has to name one.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="callweft-")
    path = f"{base.rstrip('/')}/callweft/graph-{uuid.uuid4().hex[:12]}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def delete() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone by then
            files.delete(folder, True)

    atexit.register(delete)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written and read back, so that plans stay short and a lost executor costs one step.

    Files have a known size, so Spark broadcasts small tables in later joins by its own size check and shuffles large ones.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *makers: Callable) -> list:
    """Results of functions that start jobs of their own, run side by side: planning and small jobs leave most cores idle."""
    shared_folder(spark)  # made once, before the threads ask for it
    with ThreadPoolExecutor(len(makers)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(maker)) for maker in makers]]
