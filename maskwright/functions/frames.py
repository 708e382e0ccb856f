"""Helpers on whole frames."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``. One is made only in local
    mode with none set, as in tests; elsewhere that would be a folder of one machine, so it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[.*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint, only after counting that at most ``max_rows`` rows exist."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that is read several times: a checkpoint in the shared folder.

    It is also a barrier: filters on a computed column are not moved below the step that
    computes it, where they would compute it again.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
