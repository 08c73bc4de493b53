"""Gapless ranks within keys without a window over the key.

``row_number() over (partition by key)`` puts a whole key into one task. Here rows are range-partitioned on
(key, order, salt), so a key of any size spreads over tasks; a rank is the row's place in its sorted partition
plus what the partitions before it hold. Only one row a partition and one row a key are summed up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut

_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id: partition << 33 | place


def gapless_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """df with ``out``: 0, 1, ... within each combination of keys, by order. df should be narrow: it is written twice.

    The number of distinct keys must be bounded (shards, lengths): their first places are broadcast. Equal rows get
    different ranks; null keys and null order values sort first and rank like any other value.
    """
    keys, order = list(keys), list(order)
    salted = cut(df.withColumn("_salt", F.monotonically_increasing_id()))
    by = [*keys, *order, "_salt"]
    placed = cut(salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt").withColumn("_at", F.monotonically_increasing_id()), salted.count())
    pid = F.shiftright("_at", 33)
    per = placed.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = per.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_pid", pid).join(starts, "_pid").withColumn("_place", F.col("_before") + F.col("_at").bitwiseAND(F.lit(_IN_PARTITION)))
    first = placed.withColumn("_pid", pid).groupBy(*keys, "_pid").agg(F.min("_at").alias("_at")).join(starts, "_pid")
    first = first.groupBy(*keys).agg(F.min(F.col("_before") + F.col("_at").bitwiseAND(F.lit(_IN_PARTITION))).alias("_first"))
    first = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    ranked = ranked.join(F.broadcast(first), on)
    return ranked.select(*df.columns, (F.col("_place") - F.col("_first")).alias(out))
