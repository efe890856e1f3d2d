"""The folder that all executors share, tables that cut lineage, and files as Arrow opens them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, for files that are read back."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chunkwright-")  # one machine, as in tests
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the folder that all executors share and read again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path as Spark lists it, and the path there."""
    local = re.match(r"(?:file:)?(?://(?=/))?(/.*)", path)
    return (pafs.LocalFileSystem(), local[1]) if local else pafs.FileSystem.from_uri(path)
