"""SimHash near-duplicates: sharded BK-trees over distinct fingerprints.

The 64 bits are cut into ``radius + 1`` blocks. Two fingerprints within ``radius`` bits agree on a whole block, and so on its
first bits: rows that agree there form a shard, and no linked pair is missed. Shards take as many of a block's bits as leave
about ``tree_size`` fingerprints in each, so trees keep their size and searches their cost when the corpus grows. Each
shard gets a BK-tree, whose children are keyed by their Hamming distance to the parent; a search follows only edges within
the radius. Trees meet the rows of their shard by shuffle: a fingerprint needs ``radius + 1`` trees and not all, and all
trees together, some 40 bytes for each of (radius + 1) * n nodes, grow with the corpus. A shard over twice ``tree_size``
rows is cut into parts: the tree of each part meets the rows of every other in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cut_groups, units
from .durable import cut
from .graph import components
from .rows import without

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_AT_ONCE = 1 << 16  # shingles whose bits are counted together
_IN_TASK = 1 << 16  # rows of shards for a task, about: searches cost far more than their bytes


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; see ``fingerprints``."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes.split: \x20 and \x09-\x0d
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(len(words) - width + 1, 1)
    begins = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        pairs = zip(begins[at : at + _AT_ONCE], stops[at : at + _AT_ONCE], strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in pairs], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp bigint): A-Z in lower case, words of [^\\x20\\x09-\\x0D], repeated shingles count again.

    A text of fewer words than ``width`` is one shingle; null or without words: fingerprint 0, linked like any other.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return docs.select(key, F.col(text).alias("_text")).mapInArrow(hashed, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp bigint")


class BkTree:
    """Children keyed by integer Hamming distance to their parent. Payloads are positions in the caller's array."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, key: int, item: int) -> None:
        node = 0
        while self.keys:
            d = (self.keys[node] ^ key).bit_count()
            below = self.children[node].get(d)
            if below is None:
                self.children[node][d] = len(self.keys)
                break
            node = below
        self.keys.append(key)
        self.items.append(item)
        self.children.append({})

    def within(self, key: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.keys else []
        while todo:
            node = todo.pop()
            d = (self.keys[node] ^ key).bit_count()
            if d <= radius:
                found.append(self.items[node])
            kids = self.children[node]
            if kids:
                todo.extend(kids[e] for e in range(max(d - radius, 0), d + radius + 1) if e in kids)
        return found


def _links(fps: list[int], sides: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Spanning links of one unit of a shard: (fp, fp) pairs that connect what lies within the radius, at most one a row."""
    root = list(range(len(fps)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree = BkTree()
    crossed = any(sides)  # two parts: one is the tree, the other searches it
    for i in sorted(range(len(fps)), key=lambda i: sides[i]):
        for j in tree.within(fps[i], radius) if not crossed or sides[i] else ():
            a, b = top(i), top(j)
            if a != b:
                root[a] = b
                yield fps[i], fps[j]
        if not sides[i]:
            tree.add(fps[i], i)


def shard_bits(n: int, radius: int, tree_size: int) -> int:
    """Leading bits of a block that leave about tree_size of n fingerprints in a shard."""
    return min(max(0, (-(-n // tree_size) - 1).bit_length()), 64 // (radius + 1))


def shards(distinct: DataFrame, radius: int, bits: int) -> DataFrame:
    """(fp, which, part): a row for each of the radius + 1 blocks, by whose first ``bits`` bits fingerprints are sharded."""
    edges = [round(64 * i / (radius + 1)) for i in range(radius + 1)]
    mask = F.lit((1 << bits) - 1)
    parts = [F.struct(F.lit(i).alias("which"), F.shiftrightunsigned("fp", 64 - at - bits).bitwiseAND(mask).alias("part")) for i, at in enumerate(edges)]
    return distinct.select("fp", F.explode(F.array(*parts)).alias("s")).select("fp", "s.which", "s.part")


def tree_sizes(distinct: DataFrame, radius: int = 2, tree_size: int = 2048) -> DataFrame:
    """(least, median, most, trees, nodes): how large the shards of distinct(fp) are."""
    n = shards(distinct, radius, shard_bits(distinct.count(), radius, tree_size)).groupBy("which", "part").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"), F.count("*").alias("trees"), F.sum("n").alias("nodes"))


def near_links(distinct: DataFrame, radius: int = 2, tree_size: int = 2048) -> DataFrame:
    """(u, v) bigint: links that connect all fingerprints of distinct(fp) within radius, spanning in each shard."""
    if not 0 <= radius < 64:
        raise ValueError("the radius must be from 0 to 63")
    n = distinct.count()
    rows = shards(distinct, radius, shard_bits(n, radius, tree_size))
    by = ["which", "part"]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[int] = []
        v: list[int] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], names=["u", "v"])

        for t in units(batches, by):
            fps = t.column("fp").to_numpy().view(np.uint64).tolist()
            for x, y in _links(fps, t.column("side").to_pylist(), radius):
                u.append(x)
                v.append(y)
            if len(u) > 50_000:
                yield out()
                u, v = [], []
        if u:
            yield out()

    return cut_groups(rows, by, F.xxhash64("fp"), 2 * tree_size, -(-n * (radius + 1) // _IN_TASK)).mapInArrow(linked, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(key, fingerprint 16 hex digits, component_id: smallest key reachable by links, itself included).

    One row for each row of docs. Equal fingerprints are one vertex, so copies cost nothing; a null key has no place in
    component_id unless its component has only null keys. Repeated rows share their component. A bit that is set in just half
    of the hashes is 0. Long texts are hashed whole, some shingles at a time; an empty table gives an empty result. Other
    columns are not read.
    """
    fps = cut(fingerprints(docs, key, text, width, seed))
    n = fps.count()
    vertices = cut(fps.groupBy("fp").agg(F.min(key).alias("least")), n)
    # Signed order of fingerprints is as good as any for roots; the smallest key is found afterwards.
    roots = components(cut(near_links(vertices.select("fp"), radius)))
    of = vertices.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.where("root is not null").join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", near: Callable[..., DataFrame] = near_duplicates, **how) -> DataFrame:
    """The columns of docs for one row of each component of ``near``: that with the smallest key; of rows that repeat a key, one.

    A row without a key stays only if no row of its component has one. Rows are matched by key and a hash of the text, so a key that stands for different texts keeps its other texts.
    """
    own = [f"_c{i}" for i in range(len(docs.columns))]  # names that nothing below uses
    name = dict(zip(docs.columns, own, strict=True))
    safe, k = docs.withColumnsRenamed(name), name[key]
    known = F.xxhash64(F.coalesce(name[text], F.lit("")))
    found = near(safe.select(F.struct(F.col(k).isNull().alias("n"), F.col(k).alias("k"), known.alias("h")).alias("id"), F.col(name[text]).alias("t")), "id", "t", **how)
    pairs = cut(found.groupBy(F.col("id.k").alias("_k"), F.col("id.h").alias("_h"), (F.col("id") == F.col("component_id")).alias("_first")).agg(F.count("*").alias("_n")), docs.count())
    rows = without(safe, {"_k": F.col(k), "_h": known}, pairs.where("not _first"), pairs.where("_first and _n > 1"))
    return rows.select(*[F.col(c).alias(old) for old, c in name.items()])
