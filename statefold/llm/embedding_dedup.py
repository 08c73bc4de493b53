"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

Each table rotates a vector pseudo-randomly (three rounds of random signs and a fast Walsh-Hadamard transform) once for
each digit of its bucket; the nearest signed axis of a rotation is the digit, and the last digit looks at as many axes only
as its bits can name. Codes have a few bits more than the label's number of vectors, so that buckets stay small however
large a label is, and more tables where codes are longer, so that pairs are found as surely. Multiprobe adds the buckets that
differ in the digit with the smallest margin.

Buckets are formed by narrow rows; only vectors in company there go, in single precision where they came so, to the tasks that
compare them exactly. Every link is counted in the first bucket where its two vectors meet, so links are never shuffled
or made distinct. Equal vectors are one vertex with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import dealt, large_groups, runs, shared
from .durable import cut
from .graph import components


class Hashing(NamedTuple):
    bits: int
    tables: int
    probes: int = 2
    seed: int = 20


def hashing_for(level: int) -> Hashing:
    """For labels of up to 2**level vectors. Of pairs at a cosine of 0.93 so many share a bucket of one table that these tables
    miss about 0.003 of them: 1.3 * 1.112**bits, a fit to measured shares, which tests measure anew for each level. So the work
    for a vector grows as the 0.19th power of a label. Codes grow by five bits while a label grows by four, as a larger one
    has more vectors that are not near but not far either: what a vector meets by chance then stays about the same."""
    bits = level + 2 + level // 4
    return Hashing(bits, math.ceil(1.3 * 1.112**bits))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, whose length is a power of two, by sums alone."""
    shape, n, h = x.shape, x.shape[-1], 1
    while h < n:
        pairs = x.reshape(*shape[:-1], n // (2 * h), 2, h)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        x = np.stack((a + b, a - b), axis=-2).reshape(shape)
        h *= 2
    return x


def _digits(bits: int, width: int) -> list[int]:
    """Axes that each digit looks at: all for as many digits as the bits fill, and a power of two for the last one."""
    whole = (2 * width).bit_length() - 1
    full, rest = divmod(bits, whole)
    return [width] * full + ([1 << (rest - 1)] if rest else [])


def bucket_codes(vectors: np.ndarray, how: Hashing) -> np.ndarray:
    """(rows, tables, 1 + probes) long: each vector's own bucket in each table, then the probed ones.

    Sums and comparisons go element by element, so a vector's codes do not depend on the batch that it is in.
    """
    rows, dim = vectors.shape
    width = 1 << max(dim - 1, 1).bit_length()
    padded = np.zeros((rows, width))
    padded[:, :dim] = vectors
    at = np.arange(rows)
    axes = _digits(how.bits, width)
    codes = np.empty((rows, how.tables, 1 + how.probes), np.int64)
    signs = np.random.default_rng([how.seed, width]).integers(0, 2, (how.tables, len(axes), 3, width)) * 2.0 - 1.0
    for t in range(how.tables):
        own, base, others, margins = np.zeros(rows, np.int64), 1, [], []
        for k, few in enumerate(axes):
            x = padded
            for r in range(3):
                x = _hadamard(x * signs[t, k, r])
            x = x[:, :few]
            # Both ends of every axis, as a single one has an other end to probe.
            ends = np.stack((x, -x), axis=2).reshape(rows, 2 * few)
            most = np.argpartition(-ends, how.probes, axis=1)[:, : 1 + how.probes] if 2 * few > 1 + how.probes else np.tile(np.arange(2 * few), (rows, 1))
            best = ends[at[:, None], most]
            order = np.argsort(-best, axis=1, kind="stable")
            nearest, best = most[at[:, None], order], best[at[:, None], order]
            own += nearest[:, 0] * base
            others.append((nearest[:, 1:] - nearest[:, :1]) * base)
            margins.append(best[:, :1] - best[:, 1:])
            base *= 2 * few
        codes[:, t, 0] = own
        steps, margin = np.concatenate(others, axis=1), np.concatenate(margins, axis=1)
        nearest = np.argsort(margin, axis=1, kind="stable")[:, : how.probes]
        codes[:, t, 1 : 1 + nearest.shape[1]] = own[:, None] + steps[at[:, None], nearest]
        codes[:, t, 1 + nearest.shape[1] :] = own[:, None]
    return codes


_MIX = np.uint64(0xFF51AFD7ED558CCD)


def bucket_names(codes: np.ndarray, label: np.ndarray) -> np.ndarray:
    """64-bit names of buckets from codes and 64-bit names of what their vectors must share; equal names of different buckets
    only make company that has no links."""
    x = codes.astype(np.uint64) * np.uint64(64) + np.arange(codes.shape[1], dtype=np.uint64)[:, None]
    x = (x ^ label.view(np.uint64)[:, None, None]) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For names of buckets of pairs, (pairs, tables, probes + 1) each: the bucket where they first meet, or the largest long."""
    hit = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
    table, at, none = hit.any(axis=2).argmax(axis=1), np.arange(len(a)), np.iinfo(np.int64).max
    return np.where(hit[at, table], a[at, table], none).min(axis=1)


_SMALL = 32  # units up to so many rows are compared together, row by row at each distance; larger ones by matrices
_AT_ONCE = 20_000


def close_pairs(unit: np.ndarray, begins: np.ndarray, side: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows of a unit, on its two sides if it has such, whose cosine is at least ``cosine``; rows are unit vectors."""
    sizes = np.diff(begins)
    ends = np.repeat(begins[1:], sizes)
    small = np.repeat(sizes <= _SMALL, sizes)
    two = np.repeat(np.logical_or.reduceat(side > 0, begins[:-1]) if len(sizes) else sizes > 0, sizes)
    at = np.arange(len(unit))
    for d in range(1, min(int(sizes.max(initial=0)), _SMALL)):
        i = at[small & (at + d < ends)]
        i = i[~two[i] | (side[i] != side[i + d])]
        for s in range(0, len(i), _AT_ONCE):
            part = i[s : s + _AT_ONCE]
            part = part[np.einsum("ij,ij->i", unit[part], unit[part + d]) >= cosine]
            yield part, part + d
    for g in np.flatnonzero(sizes > _SMALL):
        rows = at[begins[g] : begins[g + 1]]
        crossed = bool(two[rows[0]])
        left = rows[side[rows] == 0]
        right = rows[side[rows] == 1] if crossed else rows
        for s in range(0, len(left), 256):
            i, j = np.nonzero(unit[left[s : s + 256]] @ unit[right].T >= cosine)
            i, j = left[s : s + 256][i], right[j]
            yield (i, j) if crossed else (i[i < j], j[i < j])


class Links:
    """Links of pairs that were found in a bucket, counted if it is the first one in which the two meet. Pairs are gathered
    from many buckets, so that codes of their vectors are made once and together."""

    def __init__(self) -> None:
        self.pairs: list[tuple[np.ndarray, ...]] = []
        self.vectors: dict[int, list[tuple[np.ndarray, ...]]] = {}  # by length
        self.size = 0

    def add(self, bucket: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, cls: np.ndarray, n: np.ndarray, alike: np.ndarray, level: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = alike[i] == alike[j]  # else two buckets have a name in common
        i, j = i[same], j[same]
        if not len(i):
            return
        used = np.unique(np.concatenate((i, j)))
        self.pairs.append((bucket[i], cls[i], cls[j], n[i], n[j]))
        self.vectors.setdefault(x.shape[1], []).append((cls[used], x[used], alike[used], level[used]))
        self.size += len(i)
        if self.size >= _AT_ONCE:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        """(cls, links, root): what the gathered pairs give each vector, and the smallest one they lead to."""
        if not self.pairs:
            return
        bucket, a, b, na, nb = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        here = np.zeros(len(a), bool)
        for found in self.vectors.values():
            cls, x, alike, level = (np.concatenate(v) for v in zip(*found, strict=True))
            cls, first = np.unique(cls, return_index=True)
            x, alike, level = x[first], alike[first], level[first]
            for lv in np.unique(level):
                mine = np.flatnonzero(level == lv)
                names = bucket_names(bucket_codes(x[mine], hashing_for(int(lv))), alike[mine])
                own = cls[mine]
                i = np.minimum(np.searchsorted(own, a), len(own) - 1)
                at = np.flatnonzero(own[i] == a)
                i, j = i[at], np.searchsorted(own, b[at])
                for s in range(0, len(at), _AT_ONCE):
                    p = slice(s, s + _AT_ONCE)
                    here[at[p]] = _first_meeting(names[i[p]], names[j[p]]) == bucket[at[p]]
        self.pairs, self.vectors, self.size = [], {}, 0
        cls, at = np.unique(np.concatenate((a[here], b[here])), return_inverse=True)
        if not len(cls):
            return
        i, j = np.split(at, 2)
        links, root = np.zeros(len(cls), np.int64), np.arange(len(cls))
        np.add.at(links, i, nb[here])
        np.add.at(links, j, na[here])
        while True:  # smallest place by links, then by jumps
            low = np.minimum(root[i], root[j])
            new = root.copy()
            for to in (i, j, root[i], root[j]):
                np.minimum.at(new, to, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(links), pa.array(cls[root])], names=["cls", "links", "root"])


def _comparable(vector: str) -> Column:
    """Neither null nor zero, and only finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of one length in double precision, each over its largest component, so that squares neither overflow nor
    vanish; cosines and buckets stay."""
    chunks = lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).astype(np.float64).reshape(-1, dim)
    return x / np.abs(x).max(axis=1, keepdims=True)


def near_duplicates(embeddings: DataFrame, cosine: float = 0.93, key: str = "vec_id", label: str = "label", vector: str = "embedding", unit_size: int = 2048) -> DataFrame:
    """One row for each vector: key, n_links (other vectors with a link), component_id (smallest key reachable), kept.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine, in double precision, is
    at least ``cosine``. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Equal
    vectors all link; repeated rows are vectors of their own; an empty table gives an empty result. A vector of any length is
    read whole. Other columns are not read.
    """
    kind = embeddings.schema[vector].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = embeddings.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).cast(kind).alias("_v"))
    rows = rows.withColumn("_ok", _comparable("_v") & F.col("_label").isNotNull())
    rows = rows.withColumn("_same", F.when(F.col("_ok"), F.xxhash64("_label", "_v")))
    classes = rows.where("_ok").groupBy("_same", "_label", "_v").agg(F.min("_key").alias("least"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    alike = F.xxhash64("_label", F.size("_v"))  # what vectors must share besides a bucket
    sizes = classes.groupBy(alike.alias("alike")).agg(F.ceil(F.log2(F.count("*"))).cast("int").alias("level"))
    leveled = cut(classes.select("cls", "n", alike.alias("alike"), "_v").join(sizes, "alike").select("cls", "n", "alike", "level", F.col("_v").alias("v")))

    def each(t: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, int, int]]:
        """Places of the rows of each length and level, and these."""
        dim, level = pc.list_value_length(t.column("v")).to_numpy(), t.column("level").to_numpy()
        for d, lv in np.unique(np.stack((dim, level)), axis=1).T.tolist():
            yield np.flatnonzero((dim == d) & (level == lv)), d, lv

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, dim, level in each(b):
                for s in range(0, len(at), 1024):
                    part = b.take(pa.array(at[s : s + 1024]))
                    names = bucket_names(bucket_codes(_matrix(part.column("v"), dim), hashing_for(level)), part.column("alike").to_numpy())
                    names = names.reshape(len(names), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(names.reshape(-1)), pa.array(np.repeat(part.column("cls").to_numpy(), names.shape[1]))], names=["bucket", "cls"])

    met = cut(shared(leveled.select("cls", "alike", "level", "v").mapInArrow(posted, "bucket bigint, cls bigint"), "bucket", "cls"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for t, _ in runs(batches, ["bucket"]):
            dims = pc.list_value_length(t.column("v")).to_numpy()
            for dim in np.unique(dims):
                part = t.filter(pa.array(dims == dim)) if (dims != dim).any() else t
                bucket, lo, hi, side, cls, n, alike, level = (part.column(c).to_numpy() for c in ("bucket", "lo", "hi", "side", "cls", "n", "alike", "level"))
                change = (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
                begins = np.concatenate(([0], np.flatnonzero(change) + 1, [len(bucket)]))
                x = _matrix(part.column("v"), int(dim))
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                for i, j in close_pairs(unit, begins, side, cosine):
                    yield from links.add(bucket, i, j, x, cls, n, alike, level)
        yield from links.rest()

    company = dealt(met.join(leveled, "cls"), "bucket", unit_size, large_groups(met, "bucket", unit_size))
    found = cut(company.mapInArrow(linked, "cls bigint, links bigint, root bigint"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    of = classes.select("_same", "_label", "_v", "cls", "least", "n").join(links, "cls", "left").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    of = of.withColumn("root", F.coalesce("root", "cls"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select(F.col("_same").alias("_s"), F.col("_label").alias("_l"), F.col("_v").alias("_w"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    same = (F.col("_same") == F.col("_s")) & (F.col("_label") == F.col("_l")) & (F.col("_v") == F.col("_w"))
    out = rows.select("_key", "_same", "_label", "_v").join(named, same, "left")
    component = F.when(F.col("_s").isNull(), F.col("_key")).otherwise(F.col("component_id"))
    return out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept"))
