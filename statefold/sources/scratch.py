"""Files that a query writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A session on this machine alone may do without that setting and gets a temporary
    folder; one with executors of their own does not: RuntimeError."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="statefold-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder there."""
    return f"{shared_folder(spark)}/{name}-{uuid4()}"


def settled(df: DataFrame) -> DataFrame:
    """df written there: its partitions are the same however often it is read, and a lost executor costs a re-read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
