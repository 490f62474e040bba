"""Tables written once and read back, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Paths only: functions sent to tasks may bring the modules they name along.
_kept: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of this machine's own,
    and only when driver and executors are one process."""
    found = spark.conf.get(KEY, None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{KEY} must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """df written as Parquet, so that a lost executor costs a re-read and not the lineage.
    The table stays until ``release`` or the program's end."""
    path = f"{shared_dir(df.sparkSession)}/quire-{uuid.uuid4().hex}"
    _kept.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df as a side of a join that is dealt out by key and never sent whole to every task.
    The size that Spark plans by is that of packed columns on disk: a table of a few MB
    there can be millions of rows."""
    return df.hint("merge")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder wherever Spark can reach it."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def release() -> None:
    """Removes all kept tables. Results that were built on them can't be read any more."""
    while _kept:
        path = _kept.pop()
        with contextlib.suppress(Exception):  # the session may be gone by now
            delete(SparkSession.active(), path)


atexit.register(release)
