"""Files as tasks outside the JVM reach them: through the cluster's own file system."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import SparkSession


def full_uri(spark: SparkSession, path: str) -> str:
    """The path with its file system, as workers outside the JVM need it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = str(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString())
    return re.sub(r"^file:/+", "file:///", uri)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)
