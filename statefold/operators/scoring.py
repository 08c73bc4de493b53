"""Scores of recorded continuations and texts, from log probabilities by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled


def continuation_scores(steps: DataFrame, request: str, best: str = "best", token: str = "tok", logp: str = "logp") -> DataFrame:
    """(request, logprob, greedy): the sum over a continuation's tokens, and whether each was the best choice."""
    return steps.groupBy(request).agg(F.sum(logp).alias("logprob"), F.bool_and(F.col(token) == F.col(best)).alias("greedy"))


def rolling_windows(df: DataFrame, seq: str, size: int) -> DataFrame:
    """df with window: disjoint windows of ``size`` scored tokens, each read after one token of context."""
    return df.withColumn("window", F.floor(F.col("t") / size).cast("bigint"))


def rolling_scores(df: DataFrame, seq: str, size: int, logp: str = "logp") -> DataFrame:
    """(seq, windows, logprob): window sums added up."""
    per = rolling_windows(df, seq, size).groupBy(seq, "window").agg(F.sum(logp).alias("_s"))
    return per.groupBy(seq).agg(F.count("*").alias("windows"), F.sum("_s").alias("logprob"))


def negative_log_likelihood(df: DataFrame, group: str, logp: str = "logp") -> DataFrame:
    """(group, n, nll nats a token, perplexity)."""
    n = df.groupBy(group).agg(F.count(logp).alias("n"), (-F.sum(logp) / F.count(logp)).alias("nll"))
    return n.withColumn("perplexity", F.exp("nll"))


def bits_per_byte(df: DataFrame, group: str, logp: str, size: str) -> DataFrame:
    """(group, bits_per_byte, tokens_per_byte) from texts' log probabilities, byte counts and token counts n."""
    return df.groupBy(group).agg((-F.sum(logp) / F.log(F.lit(2.0)) / F.sum(size)).alias("bits_per_byte"), (F.sum("n") / F.sum(size)).alias("tokens_per_byte"))


def weighted_cross_entropy(df: DataFrame, logp: str, target: str, end: int, end_weight: float, ignore: int = -100, by: Sequence[str] = ()) -> DataFrame:
    """(by, loss): weighted mean of -logp; end tokens have a weight of their own, ignored targets none."""
    weight = F.when(F.col(target) == ignore, 0.0).when(F.col(target) == end, float(end_weight)).otherwise(1.0)
    return df.groupBy(*by).agg((-F.sum(weight * F.col(logp)) / F.sum(weight)).alias("loss"))


def truncated_pairs(df: DataFrame, max_length: int, context: str = "context", continuation: str = "continuation") -> DataFrame:
    """df with both arrays cut from the left to max_length + 1 ids together, the continuation last to go."""
    full = F.concat(context, continuation)
    kept = F.when(F.size(full) > max_length + 1, F.slice(full, F.size(full) - max_length, max_length + 1)).otherwise(full)
    n = F.least(F.size(continuation), F.size(kept))
    return df.withColumn("_full", kept).withColumn("_n", n).withColumns({context: F.slice("_full", 1, F.size("_full") - F.col("_n")), continuation: F.when(F.col("_n") > 0, F.slice("_full", F.size("_full") - F.col("_n") + 1, F.col("_n"))).otherwise(F.slice("_full", 1, 0))}).drop("_full", "_n")


def parity(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """(rows, max_diff, unmatched): how far two results for the same rows are apart."""
    joined = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on, "full")
    return joined.agg(F.count("*").alias("rows"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff"), F.sum((F.col("_a").isNull() | F.col("_b").isNull()).cast("bigint")).alias("unmatched"))


def key_difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that are missing or unexpected."""
    missing = expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("missing"))
    extra = found.select(key).distinct().join(expected.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra)


def request_order(df: DataFrame, request: str) -> DataFrame:
    return df.orderBy(request)


def batches(df: DataFrame, size: int, order: str, ties: Sequence[str] = ()) -> DataFrame:
    """df with batch: rows by falling order (ties by their columns), ``size`` to a batch, numbered from 0 without gaps.

    Rows are dealt into ranges of the order and numbered there; ranges begin where those before them end, by one count each.
    """
    by = [F.desc(order), *ties]
    ranged = settled(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn("batch", F.floor(place / size).cast("bigint")).select(*df.columns, "batch")


def previous(df: DataFrame, seq: str, column: str, out: str) -> DataFrame:
    return df.withColumn(out, F.lag(column).over(Window.partitionBy(seq).orderBy("t")))
