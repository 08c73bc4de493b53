"""Cutting lineage in the folder that driver and executors share, and dealing rows to all cores."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_IN_FILE = 500_000  # narrow rows that one task of a checkpoint writes, at least where it has them
BATCH = 4 << 20  # bytes of rows that Python gets at once, and one row more
SCANNED = 256  # rows that Parquet's reader holds at once


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where none is set a session on this machine alone gets a temporary folder; one with
    executors of their own does not, as they would not see each other's files: RuntimeError."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="statefold-"))
    return sc.getCheckpointDir()


def lower_batches(spark: SparkSession) -> dict[str, str | None]:
    """Have the session read Parquet by SCANNED rows and give Python about BATCH bytes at once, where it has higher limits; what it had set
    for those.

    Spark's own are 4,096 rows, of which each task has all texts on the heap, in arrays that it doubles, and 64 MB, of which the
    JVM and the worker of each task hold several copies beside the heap. With long texts executors run out of either.
    """
    now = spark._jsparkSession.sessionState().conf()
    limits = {"spark.sql.parquet.columnarReaderBatchSize": (now.parquetVectorizedReaderBatchSize(), SCANNED), "spark.sql.execution.arrow.maxBytesPerBatch": (now.arrowMaxBytesPerBatch(), BATCH)}
    lower = {k: most for k, (has, most) in limits.items() if has > most}
    before = {k: spark.conf.get(k, None) for k in lower}
    for k, most in lower.items():
        spark.conf.set(k, str(most))
    return before


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within has batches as ``lower_batches`` sets them."""
    before = lower_batches(spark)
    try:
        yield
    finally:
        for k, own in before.items():
            spark.conf.unset(k) if own is None else spark.conf.set(k, own)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise df reliably, so that a lost executor costs a re-read and not a recomputation.

    Every partition becomes a file of the shared folder. ``rows``, a bound on the rows of a narrow result of a shuffle, joins
    neighbouring partitions without another shuffle, so that small results do not become many files: as many partitions
    stay as give each ROWS_IN_FILE rows, and one for each core. What reads texts keeps the partitions of its scan, and takes
    them in small batches. Files of earlier results that nothing needs any more are released.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_IN_FILE)))
    with small_batches(spark):
        out = df.checkpoint(eager=True)
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints of results that nothing refers to any more. Its cleaner waits for the
    driver's garbage collector, which may not run for a whole job of many rounds, while disks fill up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(scan: DataFrame) -> DataFrame:
    """scan, with its rows dealt anew if it has rows in fewer partitions than there are cores, as one file of one row group has.

    Only a table of fewer files than cores is looked at, and that reads no column.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if len(scan.inputFiles()) >= cores or scan.select(F.spark_partition_id()).distinct().count() >= cores:
        return scan
    return scan.repartition(cores)
