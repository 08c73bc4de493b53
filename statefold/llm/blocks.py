"""Groups of any size for pairwise work: large ones are cut into parts, and every pair of parts is a task's unit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import cut

UNIT = ("lo", "hi")


def cut_groups(rows: DataFrame, by: Sequence[str], part_of: Column, size: int, tasks: int | None = None) -> DataFrame:
    """rows with lo, hi, side, sorted by group in their partitions, each unit (by, lo, hi) in one.

    A group of at most ``size`` rows is one unit, lo = hi = 0. A larger one is dealt by part_of (a hash) into parts of
    about ``size``; each pair of parts is a unit whose rows have side 0 (of lo) and 1 (of hi), and each part alone is one.
    So two rows of a group meet in exactly one unit, and no task needs more than two parts. ``tasks``: into how many partitions
    units are dealt; by default as many as their bytes call for, which is too few where rows are narrow and work is not.
    """
    by = list(by)
    large = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    rows = rows.join(large.select(*by, F.ceil(F.col("_n") / size).cast("int").alias("_parts")), by, "left")
    rows = rows.withColumn("_mine", F.pmod(part_of, F.coalesce("_parts", F.lit(1))).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.expr("sequence(0, coalesce(_parts, 1) - 1)")))
    rows = rows.withColumns({"lo": F.least("_mine", "_other"), "hi": F.greatest("_mine", "_other"), "side": (F.col("_mine") > F.col("_other")).cast("int")})
    rows = rows.drop("_parts", "_mine", "_other")
    dealt = rows.repartition(*by, *UNIT) if tasks is None else rows.repartition(max(tasks, 1), *by, *UNIT)
    return dealt.sortWithinPartitions(*by, *UNIT)


def shared(rows: DataFrame, group: str, item: str, *order: str) -> DataFrame:
    """The rows whose group has two or more different items, one for each item, sorted by group, ``order`` and item in their
    partitions, and ``place``: 0, 1, ... within the group. One shuffle, of the rows as they are; group and item must be
    integers without null, and rows of an item equal but for what is not read. A group is never held: rows stream by."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, 0  # the last row, and how many items of its group came before it
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            g, x = t.column(group).to_numpy(), t.column(item).to_numpy()
            first = np.concatenate(([True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])))
            t, g = t.filter(pa.array(first)), g[first]
            at = np.arange(len(g))
            begins = np.concatenate(([True], g[1:] != g[:-1]))
            place = at - np.maximum.accumulate(np.where(begins, at, 0))
            place[: int(np.argmax(begins[1:])) + 1 if begins[1:].any() else len(g)] += before
            out = (place > 0) | np.concatenate((g[1:] == g[:-1], [False]))
            out[-1] = False  # whether it has company shows later
            yield from t.append_column("place", pa.array(place)).filter(pa.array(out)).to_batches()
            held, before = t.slice(len(g) - 1), int(place[-1])
        if held is not None and before:
            yield from held.append_column("place", pa.array([before])).to_batches()

    return rows.repartition(group).sortWithinPartitions(group, *order, item).mapInArrow(kept, f"{kinds}, place bigint")


def large_groups(rows: DataFrame, group: str, size: int) -> DataFrame:
    """(group, _parts): groups of more than ``size`` items, from rows as ``shared`` gives them; few, as items beyond it say so."""
    beyond = rows.where(F.col("place") >= size).groupBy(group).agg(F.max("place").alias("_most"))
    return cut(beyond.select(group, (F.floor(F.col("_most") / size) + 1).cast("int").alias("_parts")), 0)


def dealt(rows: DataFrame, group: str, size: int, large: DataFrame) -> DataFrame:
    """rows (with place) in units, as ``cut_groups`` makes them, without counting or moving the rows of groups up to ``size``."""
    if large.isEmpty():
        out = rows.withColumns({"lo": F.lit(0), "hi": F.lit(0), "side": F.lit(0)})
    else:
        other = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
        out = rows.join(large, group, "left").withColumns({"_mine": F.floor(F.col("place") / size).cast("int"), "_other": other})
        out = out.withColumns({"lo": F.least("_mine", "_other"), "hi": F.greatest("_mine", "_other"), "side": (F.col("_mine") > F.col("_other")).cast("int")})
    out = out.drop("place", "_parts", "_mine", "_other")
    return out.repartition(group, *UNIT).sortWithinPartitions(group, *UNIT)


def runs(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units (runs of equal by, lo, hi), and where their units begin and the last one ends; keys must be
    integers without null. A table is a batch and what was left of the one before."""
    keys, held = [*by, *UNIT], None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not t.num_rows:
            continue
        at = _runs(t, keys)
        held = t.slice(at[-2])
        if at[-2]:
            yield t.slice(0, at[-2]), np.array(at[:-1])
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def units(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.Table]:
    """The units with two or more rows, one at a time."""
    for t, at in runs(batches, by):
        for i in np.flatnonzero(np.diff(at) > 1):
            yield t.slice(at[i], at[i + 1] - at[i])


def _runs(t: pa.Table, keys: Sequence[str]) -> list[int]:
    n = t.num_rows
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        x = t.column(k).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return [*np.flatnonzero(change).tolist(), n]
