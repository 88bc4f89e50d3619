"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this process has made and not deleted yet: (session, folder).
_made: dict[str, SparkSession] = {}


def store(spark: SparkSession, path: str):
    """The file system that a path is on, and the path in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder if the session runs on this machine alone, else a ValueError."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gradeflow-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder path; what is there is deleted by ``delete`` or when the process ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    fs, at = store(spark, path)
    fs.delete(at, True)
    _made.pop(path, None)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts lineage, survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes written tables that no frame still to be computed reads."""
    for df in frames:
        if df is not None:
            delete(df.sparkSession, df._folder)
