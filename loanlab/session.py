"""Shared folder and lineage cutting.

The shared folder is the one named in ``spark.checkpoint.dir`` or set on the context. The
library's operators never choose one: entry points name it, by ``name_local_folder`` for a
local session that has none.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and intermediate tables."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return sc.getCheckpointDir().rstrip("/")


def name_local_folder(spark: SparkSession) -> None:
    """For entry points: a folder for a local session without one. A cluster must name its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.getCheckpointDir() is None and sc.master.split("[")[0] == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loanlab-"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/loanlab/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the path (local, HDFS, object store)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there, through the Hadoop file system of the path."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def let_go(spark: SparkSession) -> None:
    """Collect garbage on the driver, between the steps of a long job.

    Shuffles, broadcasts and checkpoints of finished steps go only when the objects that stand for them are
    collected, and a driver that never has to collect grows to its limit.
    """
    gc.collect()
    spark._jvm.System.gc()
