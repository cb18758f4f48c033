"""Cutting lineage: tables written in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

#: For a folder on a local disk, where Hadoop without its native library starts a process (chmod) for each file
#: and folder that it makes, from executors of any size: no checksum file beside each file (Parquet's pages have
#: their own), no marker of success. Other file systems' checksums are as they were.
WRITING = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}

_LOCAL: list[str] = []
_OPEN: list[list[str]] = []  # what was settled within each open scratch()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder serves, but only in a single-JVM local session;
    on a cluster a machine-local folder would not be seen by the other executors, so that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quillon-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def writer(df: DataFrame) -> DataFrameWriter:
    """df.write, with as few files and processes as a table of our own needs."""
    return df.write.options(**WRITING)


def settle(df: DataFrame, *, outer: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder now, and return a DataFrame that reads it back.

    A lost executor then costs no more than the tasks it ran: what was written is never recomputed.
    The table stays until the scratch() around it ends (``outer``: the one around that), or else until
    the folder is cleared: a DataFrame that an operator returns may still read what was settled for it.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession)
    for opened in _OPEN[: -1 if outer else None][-1:]:
        opened.append(path)
    writer(df).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a settled table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving, also by an error, what was settled within; what is still wanted must have been
    settled ``outer`` by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            discard(spark, path)
