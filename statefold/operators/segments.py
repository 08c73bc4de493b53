"""Documents within sequences, and stencils that do not cross their boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled


def segmented(df: DataFrame, seq: str, order: Sequence[str], sentinel: Column, carried: Column | bool = False) -> DataFrame:
    """df with t (place in the sequence, from 0), reset (first row after a sentinel) and doc (running number of resets).

    The sentinel row belongs to the document that it ends. ``carried`` says whether the row before the sequence was one.
    One shuffle by sequence; what follows by (seq, doc) or (seq, block) reuses it.
    """
    w = Window.partitionBy(seq).orderBy(*order)
    before = F.coalesce(F.lag(sentinel).over(w), carried if isinstance(carried, Column) else F.lit(carried))
    marked = df.withColumn("t", (F.row_number().over(w) - 1).cast("bigint")).withColumn("reset", before)
    running = Window.partitionBy(seq).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("doc", F.sum(F.col("reset").cast("bigint")).over(running))


def segmented_in_ranges(df: DataFrame, seq: str, order: Sequence[str], sentinel: Column) -> DataFrame:
    """What ``segmented`` gives, for sequences that are too long for a task: rows are dealt into ranges of (seq, order), numbered
    within each, and what a range adds to a sequence that goes on in the next is added up from one row a range and sequence.

    Rows must differ in (seq, order), or they may be numbered otherwise when read again.
    """
    cut = df.withColumn("_s", F.coalesce(sentinel, F.lit(False))).repartitionByRange(seq, *order).withColumn("_range", F.spark_partition_id())
    cut = settled(cut)
    w = Window.partitionBy("_range", seq).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.withColumns({"t": F.row_number().over(w) - 1, "reset": F.lag("_s").over(w), "_ends": F.sum(F.col("_s").cast("bigint")).over(running)})
    parts = cut.groupBy(F.col(seq).alias("_seq"), F.col("_range").alias("_part")).agg(F.count("*").alias("_n"), F.sum(F.col("_s").cast("bigint")).alias("_e"), F.max_by("_s", F.struct(*order)).alias("_last"))
    over = Window.partitionBy("_seq").orderBy("_part")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select("_seq", "_part", F.sum("_n").over(before).alias("_t0"), F.sum("_e").over(before).alias("_e0"), F.lag("_last").over(over).alias("_open")).where("_t0 is not null")
    # Only sequences that begin in an earlier range have such a row: one a range at most, as ranges are in order.
    joined = own.join(F.broadcast(ahead), F.col(seq).eqNullSafe(F.col("_seq")) & (F.col("_range") == F.col("_part")), "left")
    reset = F.coalesce("reset", "_open", F.lit(False))
    ended = F.col("_ends") - F.col("_s").cast("bigint") + F.coalesce("_e0", F.lit(0))  # sentinels before the row
    return joined.select(*df.columns, (F.col("t") + F.coalesce("_t0", F.lit(0))).cast("bigint").alias("t"), reset.alias("reset"), ended.cast("bigint").alias("doc"))


def segment_stats(df: DataFrame, seq: str, value: str) -> DataFrame:
    """One row for each document: rows, first and last place, sum of a value."""
    return df.groupBy(seq, "doc").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum(value).alias("total"))


def _within(seq: str) -> Window:
    return Window.partitionBy(seq, "doc").orderBy("t")


def token_shift(df: DataFrame, seq: str, x: str, mu: float, out: str = "shifted") -> DataFrame:
    """mu * x + (1 - mu) * the row before; zero before a document."""
    before = F.coalesce(F.lag(x).over(_within(seq)), F.lit(0.0))
    return df.withColumn(out, F.lit(mu) * F.col(x) + F.lit(1.0 - mu) * before)


def causal_conv(df: DataFrame, seq: str, x: str, taps: Sequence[float], bias: float = 0.0, out: str = "conv") -> DataFrame:
    """Weighted sum of a row and those before it in its document; the last tap is the row's own, missing rows are zero."""
    w, total = _within(seq), F.lit(float(bias))
    for back, tap in enumerate(reversed(list(taps))):
        value = F.col(x) if back == 0 else F.coalesce(F.lag(x, back).over(w), F.lit(0.0))
        total = total + F.lit(float(tap)) * value
    return df.withColumn(out, total)


def stencil_history(df: DataFrame, seq: str, x: str, size: int = 3) -> DataFrame:
    """For each sequence the last values of its open document, oldest first and zero-filled: what a later call goes on from."""
    last = df.groupBy(seq).agg(F.max("doc").alias("doc"))
    w = Window.partitionBy(seq).orderBy(F.desc("t"))
    tail = df.join(last, [seq, "doc"]).withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= size)
    kept = tail.groupBy(seq).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("o"), F.col(x).alias("x")))), lambda p: p.x).alias("_h"))
    return kept.select(seq, F.concat(F.array_repeat(F.lit(0.0), F.lit(size) - F.size("_h")), F.col("_h")).alias("history"))


def keep_last(df: DataFrame, seq: str, k: int) -> DataFrame:
    """The last k rows of each sequence; none for k = 0."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(seq).orderBy(F.desc("t")))).where(F.col("_r") <= k).drop("_r")


def before_first_stop(df: DataFrame, seq: str, stop: Column) -> DataFrame:
    """Rows before the first stop of their sequence; the stop itself does not come out."""
    first = F.min(F.when(stop, F.col("t"))).over(Window.partitionBy(seq))
    return df.withColumn("_stop", first).where(F.col("_stop").isNull() | (F.col("t") < F.col("_stop"))).drop("_stop")


def repeated_ngrams(df: DataFrame, seq: str, token: str, n: int, window: int = 64) -> DataFrame:
    """df with repeated: whether the n-gram that ends here ended before among the last ``window`` tokens."""
    if n < 2:
        return df.withColumn("repeated", F.lit(False))
    w = Window.partitionBy(seq).orderBy("t")
    parts = [F.lag(token, i).over(w) for i in range(n - 1, 0, -1)] + [F.col(token)]
    grams = df.withColumn("_gram", F.when(F.col("t") >= n - 1, F.array(*parts)))
    near = F.lag("t").over(Window.partitionBy(seq, "_gram").orderBy("t"))
    seen = F.col("_gram").isNotNull() & F.coalesce(F.col("t") - near <= window - n, F.lit(False))
    return grams.withColumn("repeated", seen).drop("_gram")
