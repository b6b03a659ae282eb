"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing, _before = threading.RLock(), 0, "false"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go after a query, until the last of the threads inside leaves."""
    global _writing, _before
    with _lock:
        if not _writing:
            _before = spark.conf.get(_CLEAN)
            spark.conf.set(_CLEAN, "true")
        _writing += 1
    try:
        yield
    finally:
        with _lock:
            _writing -= 1
            if not _writing:
                spark.conf.set(_CLEAN, _before)


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the session's checkpoint folder and read from there, so that it is computed once.

    Its shuffle files go when the table is there.  A folder is made only where the
    session names none and all tasks run on this machine.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    with _lock:
        if sc.getCheckpointDir() is None:
            named = spark.conf.get("spark.checkpoint.dir", None)
            if not named and not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinfold-"))
    path = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kinfold_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that cut has written and nothing still to be computed reads; others are left alone."""
    for df in tables:
        path = None if df is None else df.__dict__.get("kinfold_path")
        if path:
            sc = df.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
