"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut


def _joined(arcs: DataFrame) -> DataFrame:
    """arcs(u, v) with m, for each u the smallest of itself and its neighbours.

    Minima are partial before they are shuffled, so a hub costs a row a task. They join on a struct of u, which the
    aggregation is not partitioned by: both sides then are shuffled for the join alone, and a hub's arcs can be split.
    """
    minima = arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).select(F.struct(F.col("u").alias("of")).alias("hub"), "m")
    return arcs.withColumn("hub", F.struct(F.col("u").alias("of"))).join(minima, "hub")


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _joined(arcs).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _joined(down).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return linked.select("e.u", "e.v")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that occurs in edges(u, v); root is the smallest node of its component.

    Nodes must be comparable and not null; self loops and repeated edges are fine. Each round is cut, so lineage stays
    short; edges are counted first, so they should be cut themselves. Raises RuntimeError if the rounds do not settle (log-many suffice), rather than return a partial answer.
    """
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), edges.count())
    seen = None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = mark
        now = cut(_small_star(_large_star(now)).where("u != v").distinct(), 2 * mark[0])  # a step makes two edges of one at most
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
