"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of its own; a
    cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ledgerloom-{spark.sparkContext.applicationId}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that ``materialised`` has written in this process and that are still there.
WRITTEN: list[str] = []


def materialised(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back, so that its lineage ends there.

    With ``release`` the shuffles that made it are deleted when it is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, str(release or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_unread(spark: SparkSession, paths: list[str], reader: DataFrame) -> None:
    """Delete those of ``paths``, written by ``materialised``, that ``reader`` does not read."""
    read = {f.rpartition("/")[0].rpartition("/")[2] for f in reader.inputFiles()}  # each has a name of its own
    for path in paths:
        if path in WRITTEN and path.rpartition("/")[2] not in read:
            own = spark._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
            WRITTEN.remove(path)


def remove_materialised(spark: SparkSession) -> None:
    """Delete all that ``materialised`` wrote in this session; call it once results are saved."""
    WRITTEN.clear()
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
