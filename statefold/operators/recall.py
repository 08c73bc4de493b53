"""Needle-recall reports: cells of ablation, condition, language and distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import wilson


def recall_cells(items: DataFrame, by: Sequence[str], distance: str, gain: str, chosen: Column, exact: Column) -> DataFrame:
    """n, mean distance, mean gain with a normal 95% half width, choice rate with Wilson's interval, exact rate."""
    n, hits = F.count("*"), F.sum(chosen.cast("int"))
    g = items.groupBy(*by).agg(n.alias("n"), F.avg(distance).alias("mean_dist"), F.avg(gain).alias("gain"), (1.96 * F.stddev_samp(gain) / F.sqrt(n)).alias("gain_ci"), hits.alias("_hits"), F.avg(exact.cast("int")).alias("exact"))
    lo, hi = wilson(F.col("_hits"), F.col("n"))
    return g.select(*by, "n", "mean_dist", "gain", "gain_ci", (F.col("_hits") / F.col("n")).alias("choice"), lo.alias("choice_lo"), hi.alias("choice_hi"), "exact")


def choices(candidates: DataFrame, item: str, score: str, is_needle: str) -> DataFrame:
    """(item, chosen): whether an item's needle has the best score of its candidates; a tie with it counts as first."""
    w = Window.partitionBy(item).orderBy(F.desc(score))
    return candidates.withColumn("_r", F.rank().over(w)).where(F.col(is_needle)).groupBy(item).agg(F.bool_or(F.col("_r") == 1).alias("chosen"))


def state_shares(shares: DataFrame, by: Sequence[str], layer: str = "layer", head: str = "head", share: str = "share", top: int = 5) -> DataFrame:
    """For each cell and layer the largest head's mean share over items, and the cell's ``top`` heads as 'layer.head=share'."""
    heads = shares.groupBy(*by, layer, head).agg(F.avg(share).alias("_m"))
    layers = heads.groupBy(*by, layer).agg(F.max("_m").alias("share"))
    w = Window.partitionBy(*by).orderBy(F.desc("_m"), layer, head)
    best = heads.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    name = F.concat(F.col(layer).cast("string"), F.lit("."), F.col(head).cast("string"), F.lit("="), F.format_number("_m", 2))
    listed = best.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", name.alias("s")))), lambda x: x.s), ", ").alias("top_heads"))
    return layers.join(listed, list(by))
