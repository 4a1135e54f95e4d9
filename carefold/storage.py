"""Where intermediate results go: folders that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application: the folder made up for it, and the folders that were named for it.
_BASES: dict[str, str] = {}
_NAMED: dict[str, list[str]] = {}


def _base(spark: SparkSession) -> str:
    """The cluster's shared folder, which ``spark.checkpoint.dir`` names.

    Where that is unset, a temporary folder serves if driver and executors are one process (a local master). On a
    cluster executors would each write to a disk of their own, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return qualified(spark, base)
    application = spark.sparkContext.applicationId
    if application not in _BASES:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _BASES[application] = "file://" + tempfile.mkdtemp(prefix="carefold-shared-")
    return _BASES[application]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system: a path without one is in the cluster's default file system."""
    if "://" in path:
        return path
    of = hadoop_path(spark, path)
    full = of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(of).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the shared folder."""
    path = f"{_base(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _NAMED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in its partitions and their order, stored in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_base(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> int:
    """Delete the folders that were named for this application so far, and say how many there were; results that read them
    must have been taken or written by then. Checkpoints go by ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    gone = 0
    for path in _NAMED.pop(spark.sparkContext.applicationId, []):
        of = hadoop_path(spark, path)
        gone += of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(of, True)
    return gone
