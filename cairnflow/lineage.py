"""Cutting lineage: reliable checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a session on one machine that names none gets a temporary one; anywhere else that is an error, since executors
    could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="cairnflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, into reliable checkpoint files in the shared folder, and go on from these."""
    shared_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    if _OPEN:
        file = done._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            _OPEN[-1].append(file.get())
    return done


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut within goes at the end; so all that stands on it must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for file in _OPEN.pop():
            remove(spark, file)
