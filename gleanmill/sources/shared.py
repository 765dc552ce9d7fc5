"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A local session without that setting gets a temporary folder; on a cluster it must be set."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gleanmill-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path within the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; later plans start from those files.

    Spark deletes the files when nothing refers to them any more, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, whatever store it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, as it is beyond that."""
    return F.broadcast(df) if len(df.limit(most + 1).take(most + 1)) <= most else df
