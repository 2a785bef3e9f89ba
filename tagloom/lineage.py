"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Bytes of one file of a packed result; there are never more files than tasks that made it.
FILE_BYTES = 1 << 20


def settle(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage with a reliable checkpoint.

    The folder is the one the cluster names in spark.checkpoint.dir. Only where that is unset and Spark runs in this one
    process is an own folder used; a cluster without the setting is an error, as executors do not share a local folder.
    Files go when nothing refers to them any more if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tagloom-"))
    return df.checkpoint(eager=True)


def packed(df: DataFrame) -> DataFrame:
    """As ``settle``, in files as many as the result needs, for results that may be small beside what they are made from.

    A checkpoint has a file for each task, empty ones too, and on a file system without native calls Hadoop starts two
    processes for each, for its permissions. The result is made by all tasks as before, held on the executors' disks, where a
    lost part is made again, and only then written by few; what is held goes at once.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        held.count()
        size = int(held.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return settle(held.coalesce(max(1, -(-size // FILE_BYTES))))
    finally:
        held.unpersist(blocking=True)
