"""Scans that every core has a part of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(scan: DataFrame) -> DataFrame:
    """scan, with its rows dealt anew if it has rows in fewer partitions than there are cores, as one file of one row group has.

    For rows that cost far more to work on than to move. Only a table of fewer files than cores is looked at, and that reads
    no column; columns that a query does not use are not moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if len(scan.inputFiles()) >= cores or scan.select(F.spark_partition_id()).distinct().count() >= cores:
        return scan
    return scan.repartition(cores)
