"""The folder that driver and executors share."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the folder set by ``setCheckpointDir``; a temporary folder of our own only where both
    are unset and all tasks run on this machine."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if got:
        return got.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + os.path.join(tempfile.gettempdir(), f"jsonweave-{os.getpid()}"))
    return _own[0]


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def short(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:12]
