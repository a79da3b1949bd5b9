"""Results that have to outlive one job: checkpoints and tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names. There is no other choice: executors do not see each other's own folders."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if not folder:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    """Path, not yet made, for one run's files."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder, on any Hadoop file system, with what is in it; one that is not there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and keep it in the shared folder: for small results used repeatedly."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def staged(df: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """``df`` computed once and kept as Parquet in the shared folder for as long as the block lasts."""
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove_folder(spark, path)
