"""Parquet tables of a data directory, and lineage cuts written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the directory; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="assay-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder for a table of one's own; deleted as those of cut() are."""
    path = f"{shared_dir(spark)}/assay-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, when it ends, the tables that operators wrote within it: `with scope(spark): p1(...).write.parquet(out)`.

    What is built within must be written within, since frames read those tables."""
    since = len(_written)
    try:
        yield
    finally:
        _delete(since)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder, so that a lost executor costs no more than a read.

    The table stays until the scope() around it ends, or the session's process, or release() is called. An empty frame
    stays empty."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(since: int) -> None:
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended before
            pass


def release() -> None:
    """Delete the tables that cut() has written so far."""
    _delete(0)


atexit.register(release)
