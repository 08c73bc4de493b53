"""Gated decaying prefix sums: S_t = exp(la_t) * S_{t-1} + v_t within each document, S before a document being zero.

Rows have a sequence, t (place in it), doc, la (log decay, never above zero) and v. Three relational plans and one over
Arrow batches give the same sums; each only ever exponentiates numbers that are not positive, so none overflows:

``pairwise``  every row with those before it: a range self-join on (seq, doc). Quadratic in a document.
``folded``    one aggregate over a document's sorted array. For short documents.
``blocked``   a fold within blocks of C rows, one partial state for each block, and the same plan over the blocks' states.
              The default: C rows are together at most, and a document of any length spreads over tasks by its blocks.
``grouped``   a loop over each sequence in Python, for documents that come whole anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _paired(df: DataFrame, on: list[str], log_sum: str) -> DataFrame:
    """y of each row: the sum over rows j <= i with equal ``on`` of v_j * exp(P_i - P_j), P the running sum of la."""
    a = df.select(*on, "t", F.col(log_sum).alias("_pa"))
    b = df.select(*on, F.col("t").alias("_tb"), F.col(log_sum).alias("_pb"), "v")
    pairs = a.join(b, on).where(F.col("_tb") <= F.col("t"))
    return pairs.groupBy(*on, "t").agg(F.sum(F.col("v") * F.exp(F.col("_pa") - F.col("_pb"))).alias("y"))


def pairwise(df: DataFrame, seq: str) -> DataFrame:
    """(seq, doc, t, y) by pairs within documents."""
    w = Window.partitionBy(seq, "doc").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _paired(df.select(seq, "doc", "t", "v", F.sum("la").over(w).alias("_p")), [seq, "doc"], "_p")


def _fold(rows: Column) -> Column:
    """From an array of (t, la, v): p and s, the sum of la and the state after the last row, and out, (t, p, y) of each row."""
    out = "array<struct<t:bigint,p:double,y:double>>"
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("s"), F.array().cast(out).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        p, s = acc.p + r.la, F.exp(r.la) * acc.s + r.v
        row = F.struct(r.t.cast("bigint").alias("t"), p.alias("p"), s.alias("y"))
        return F.struct(p.alias("p"), s.alias("s"), F.concat(acc.out, F.array(row)).alias("out"))

    return F.aggregate(F.array_sort(rows), start, step)


def folded(df: DataFrame, seq: str) -> DataFrame:
    """(seq, doc, t, y) by a fold over each document's rows in order."""
    rows = df.groupBy(seq, "doc").agg(F.collect_list(F.struct("t", "la", "v")).alias("_r"))
    return rows.select(seq, "doc", F.explode(_fold(F.col("_r")).out).alias("_o")).select(seq, "doc", "_o.t", "_o.y")


def block_states(df: DataFrame, seq: str, size: int) -> DataFrame:
    """(seq, doc, blk, n, la, v): what each block of ``size`` places does to a document's state, an (A, U) pair.

    Pairs combine in order by (A, U) . (A', U') = (A + A', exp(A') * U + U'); rows of a block are summed before a shuffle
    could be needed, as it is the one of the sequence's window.
    """
    return _in_blocks(df, seq, size).groupBy(seq, "doc", "blk").agg(F.count("*").alias("n"), F.sum("la").alias("la"), F.sum(F.col("v") * F.exp(F.col("_end") - F.col("_p"))).alias("v"))


def _in_blocks(df: DataFrame, seq: str, size: int) -> DataFrame:
    block = df.select(seq, "doc", "t", "la", "v", F.floor(F.col("t") / size).cast("bigint").alias("blk"))
    # Sums run within a document's part of a block: rows of other documents may share its places one level up. For the
    # document that was open before the block they still run from the block's start.
    part = Window.partitionBy(seq, "blk", "doc")
    summed = block.withColumn("_p", F.sum("la").over(part.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Running sums fall, so the last one is the smallest.
    return summed.withColumn("_end", F.min("_p").over(part))


def blocked(df: DataFrame, seq: str, size: int = 64, levels: int = 2) -> DataFrame:
    """(seq, doc, t, y) by blocks; with ``levels`` levels, documents of size ** levels rows are folded ``size`` rows at a time.

    Rows that lie by sequence already are grouped into blocks without another shuffle.
    """
    if levels <= 1:
        return pairwise(df, seq)
    block = F.floor(F.col("t") / size).cast("bigint").alias("blk")
    held = df.select(seq, "doc", block, F.struct("t", "la", "v").alias("_r")).groupBy(seq, "doc", "blk").agg(F.collect_list("_r").alias("_r"))
    own = held.select(seq, "doc", "blk", _fold(F.col("_r")).alias("_f"))
    states = own.select(seq, "doc", F.col("blk").alias("t"), F.col("_f.p").alias("la"), F.col("_f.s").alias("v"))
    carried = blocked(states, seq, size, levels - 1).select(seq, "doc", (F.col("t") + 1).alias("blk"), F.col("y").alias("_in"))
    # A state comes in only for the document that was open before the block, whose rows begin the block.
    out = own.join(carried, [seq, "doc", "blk"], "left").select(seq, "doc", "_in", F.explode("_f.out").alias("_o"))
    return out.select(seq, "doc", "_o.t", (F.col("_o.y") + F.coalesce(F.exp("_o.p") * F.col("_in"), F.lit(0.0))).alias("y"))


def grouped(df: DataFrame, seq: str) -> DataFrame:
    """(seq, doc, t, y) by a loop over each sequence; rows stream through in order, one sequence after the other."""
    import math

    import pyarrow as pa

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, s = None, 0.0
        for b in batches:
            out = []
            for q, d, la, v in zip(*[b.column(c).to_pylist() for c in (seq, "doc", "la", "v")], strict=True):
                s = (math.exp(la) * s if (q, d) == key else 0.0) + v
                key = (q, d)
                out.append(s)
            yield pa.RecordBatch.from_arrays([b.column(seq), b.column("doc"), b.column("t"), pa.array(out, pa.float64())], names=[seq, "doc", "t", "y"])

    kind = df.schema[seq].dataType.simpleString()
    rows = df.select(seq, F.col("doc").cast("bigint"), F.col("t").cast("bigint"), F.col("la").cast("double"), F.col("v").cast("double"))
    return rows.repartition(seq).sortWithinPartitions(seq, "doc", "t").mapInArrow(scan, f"`{seq}` {kind}, doc bigint, t bigint, y double")


def _merged(states: DataFrame, seq: str, by: Column) -> DataFrame:
    """States of one document that are neighbours, merged in order: by tells which belong together."""
    both = states.withColumn("_to", by).groupBy(seq, "doc", "_to").agg(F.sum("n").alias("n"), F.sum("la").alias("la"), F.array_sort(F.collect_list(F.struct("blk", F.col("la").alias("a"), "v"))).alias("_s"))
    v = F.aggregate("_s", F.lit(0.0), lambda s, b: F.exp(b.a) * s + b.v)
    return both.select(seq, "doc", F.col("_to").alias("blk"), "n", "la", v.alias("v"))


def final_state(df: DataFrame, seq: str, size: int = 64, levels: int = 3) -> DataFrame:
    """(seq, doc, n, state): each document's state after its last row, from its blocks' states.

    States are merged ``size`` at a time, level by level, so a document of size ** (levels + 1) rows never has more than
    ``size`` of them in one row; what is left after the levels is merged at once.
    """
    states = block_states(df, seq, size)
    for _ in range(levels - 1):
        states = _merged(states, seq, F.floor(F.col("blk") / size).cast("bigint"))
    return _merged(states, seq, F.lit(0)).select(seq, "doc", "n", F.col("v").alias("state"))


def masked_pairs(df: DataFrame, seq: str, size: int) -> DataFrame:
    """(seq, blk, pairs): how many (reader, written) pairs of one document are visible in each block."""
    b = df.select(seq, "doc", F.floor(F.col("t") / size).cast("bigint").alias("blk"))
    n = b.groupBy(seq, "doc", "blk").agg(F.count("*").alias("n"))
    # A document's rows in a block follow each other, so row i of n sees i rows: no join is needed to count them.
    return n.groupBy(seq, "blk").agg(F.sum((F.col("n") * (F.col("n") + 1) / 2).cast("bigint")).alias("pairs"))
