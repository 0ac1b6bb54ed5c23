"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs on this machine.

    What has been stored there is removed by Spark once nothing refers to it, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set for the session.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints", f"stratalog-{os.getpid()}")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared checkpoint folder; what follows survives lost executors without recomputing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage now, so Spark's cleaner removes the shuffle files and checkpoints that nothing refers to any more.

    Otherwise they stay until the driver's memory happens to fill, and how much disk a job takes is left to chance.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
