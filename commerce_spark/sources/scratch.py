"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that the context has. Where neither is set, a temporary folder in local
    mode; on a cluster an error."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    at = sc._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
        at = sc._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of this name, which goes when the driver ends."""
    at = f"{shared(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back as columns; the folder goes when the driver ends. An executor that is lost takes
    nothing with it."""
    at = f"{folder(df.sparkSession, name)}/rows"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
