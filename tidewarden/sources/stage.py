"""Intermediate tables in the shared folder of the session.

A table that several later steps read is written once and read back: the plan
that made it is not repeated, lineage ends there, and a lost executor costs a
re-read, not a re-run.  The folder is the one that ``spark.checkpoint.dir`` or
``setCheckpointDir`` names.  Where a session names none, a single-process session
gets a folder of its own, and any other session gets an error: executors on other
machines would not see it.  Folders written here are removed when Python ends, or
earlier through :func:`release`.
"""

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}

#: Rows beyond which a written table is never broadcast unless a caller says so.
LARGE = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; an error where none is known."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewarden-"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared one."""
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`scratch` gave, in whatever store it lies."""
    _written.pop(path, None)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet and return the written table.

    Joins read the size of a table off its packed files, which can be a small part of its
    rows in memory; so a table of more than LARGE rows is marked to be merged, and its rows
    do not pass through the driver.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if out.count() > LARGE:
        out = out.hint("merge")
    out.staged_at = path
    return out


def release(df: DataFrame) -> None:
    """Remove the folder of a frame that :func:`stage` returned and that nothing reads any more."""
    if path := getattr(df, "staged_at", None):
        remove(df.sparkSession, path)


@contextlib.contextmanager
def released():
    """Folders written inside are removed at its end: for work that is done over and over."""
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            remove(_written[path], path)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            remove(spark, path)
