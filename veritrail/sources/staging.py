"""Intermediate tables in the shared folder: computed once, read by every later step, and kept when executors are lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder in the one that spark.checkpoint.dir names; it may be deleted once the application has ended. Where that is unset, one of our own if all runs on this machine, and an error otherwise."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared_folder.own = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="spark-shared-")
    return shared_folder.own


def staged(df: DataFrame, what: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan, dealt out over all cores if its files have fewer parts than those, as one small file has. A large table has more, and stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def versions(spark: SparkSession, folder: str) -> set[int]:
    """The versions of a table that have been written whole: folder/version=N."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")
    found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
    return {int(str(x.getPath().getParent().getName()).partition("=")[2]) for x in found or ()}
