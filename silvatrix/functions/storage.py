"""Tables cut from their lineage in the folder that driver and executors share, and small files in any store."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame) -> DataFrame:
    """``df`` checkpointed under ``spark.checkpoint.dir``.

    A folder is set only where a session of one process has none, as in tests;
    on a cluster its own folders would be out of executors' sight.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = "file://" + tempfile.mkdtemp(prefix="silvatrix-")
        sc.setCheckpointDir(found)
    return df.checkpoint()


def read_file(path: str, spark: SparkSession | None = None) -> bytes:
    """A small file, such as a model, from any file system that Spark reads; without a session from the local one."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return Path(path).read_bytes()
    rows = spark.read.format("binaryFile").load(_located(path)).select("content").take(2)
    if len(rows) != 1:
        raise FileNotFoundError(f"{path}: {'several files' if rows else 'no file'}")
    return bytes(rows[0]["content"])


def write_file(path: str, data: bytes, spark: SparkSession | None = None) -> None:
    """Write a small file to any file system that Spark reads, over what is there."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        Path(path).write_bytes(data)
        return
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_located(path))
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    try:
        out.write(data)
    finally:
        out.close()


def _located(path: str) -> str:
    """Without a scheme: a path of this machine, as a model's is."""
    return path if "://" in path or path.startswith("file:") else Path(path).absolute().as_uri()
