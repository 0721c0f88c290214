"""Intermediate tables that outlive an executor, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in local tests.
LOCAL_FALLBACK = "/tmp/checkpoints/pathwarden"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; a local one stands in only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return named or LOCAL_FALLBACK


def ready(spark: SparkSession) -> None:
    """Let checkpoints go to the shared folder where the session has set no other."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder now and read from there ever after."""
    ready(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as a columnar table in the shared folder and read from there, and the path for :func:`discard`.

    Readers take the columns they need.  What is read knows nothing of the plan behind it; a checkpoint keeps the plan's constraints, which
    multiply with every round of a loop.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that :func:`stored` wrote, through the file system they are in."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
