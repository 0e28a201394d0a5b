"""Intermediate tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset a local master gets a temporary folder, removed at exit; a cluster, whose machines share no
    local folder, is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="graphloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it wants it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession) -> str:
    """The name of a folder yet to be written; the session removes it when it ends."""
    path = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start here and survive lost executors."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove the tables of ``cut`` frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_cut_path", None) if "_cut_path" in vars(df) else None
        if path:
            fs, at = file_system(df.sparkSession, path)
            fs.delete(at, True)
