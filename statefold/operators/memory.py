"""Associative memory: values written under keys with decay, and read by queries of the same document."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot


def paired_reads(df: DataFrame, seq: str, value: str = "v") -> DataFrame:
    """(seq, doc, t, y): sum over j <= t of exp(P_t - P_j) * (q_t . k_j) * v_j, for scalar values, by a range self-join.

    Rows have q and k (arrays), la and a scalar value. Quadratic in a document: for checks and short documents.
    """
    w = Window.partitionBy(seq, "doc").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_p", F.sum("la").over(w))
    a = rows.select(seq, "doc", "t", "q", F.col("_p").alias("_pa"))
    b = rows.select(seq, "doc", F.col("t").alias("_tb"), "k", F.col(value).alias("_v"), F.col("_p").alias("_pb"))
    pairs = a.join(b, [seq, "doc"]).where(F.col("_tb") <= F.col("t"))
    return pairs.groupBy(seq, "doc", "t").agg(F.sum(F.exp(F.col("_pa") - F.col("_pb")) * dot(F.col("q"), F.col("k")) * F.col("_v")).alias("y"))


def delta_reads(df: DataFrame, seq: str) -> DataFrame:
    """(seq, doc, t, y array): reads of a state that writes only what it does not predict yet,
    S_t = exp(la_t) S_{t-1} + k_t beta_t (v_t - exp(la_t) k_t S_{t-1})'. Rows have q, k, v (arrays), la and beta.

    A write depends on the state before it, so rows go one by one; what is carried is one matrix, whatever the length.
    """
    import numpy as np
    import pyarrow as pa

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for s, d, q, k, v, la, beta in zip(*[b.column(c).to_pylist() for c in (seq, "doc", "q", "k", "v", "la", "beta")], strict=True):
                k, v = np.array(k), np.array(v)
                if (s, d) != key:
                    key, state = (s, d), np.zeros((len(k), len(v)))
                state *= np.exp(la)
                state += np.outer(k, beta * (v - k @ state))
                out.append(np.array(q) @ state)
            yield pa.RecordBatch.from_arrays([b.column(seq), b.column("doc"), b.column("t"), pa.array(out, pa.list_(pa.float64()))], names=[seq, "doc", "t", "y"])

    kind = df.schema[seq].dataType.simpleString()
    rows = df.select(seq, F.col("doc").cast("bigint"), F.col("t").cast("bigint"), *[F.col(c).cast("array<double>") for c in "qkv"], *[F.col(c).cast("double") for c in ("la", "beta")])
    return rows.repartition(seq).sortWithinPartitions(seq, "doc", "t").mapInArrow(scan, f"`{seq}` {kind}, doc bigint, t bigint, y array<double>")


def scanned_reads(df: DataFrame, seq: str, chunk: int = 64) -> DataFrame:
    """(seq, doc, t, y array): reads of the matrix state S_t = exp(la_t) S_{t-1} + k_t v_t', with array values.

    Rows stream through in order and are multiplied block by block; what is carried is one matrix, whatever the length.
    """
    import numpy as np
    import pyarrow as pa

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            seqs, docs = b.column(seq).to_pylist(), b.column("doc").to_pylist()
            q, k, v = (np.array(b.column(c).to_pylist(), float) for c in "qkv")
            la = b.column("la").to_numpy(zero_copy_only=False)
            out = np.empty_like(v)
            at = 0
            while at < len(seqs):
                to = at + 1
                while to < len(seqs) and to - at < chunk and (seqs[to], docs[to]) == (seqs[at], docs[at]):
                    to += 1
                if (seqs[at], docs[at]) != key:
                    key, state = (seqs[at], docs[at]), np.zeros((k.shape[1], v.shape[1]))
                s = slice(at, to)
                p = np.cumsum(la[s])
                seen = np.tril(np.ones((to - at, to - at), bool))
                decay = np.exp(np.where(seen, p[:, None] - p[None, :], -np.inf))
                out[s] = ((q[s] @ k[s].T) * decay) @ v[s] + np.exp(p)[:, None] * (q[s] @ state)
                state = np.exp(p[-1]) * state + (k[s] * np.exp(p[-1] - p)[:, None]).T @ v[s]
                at = to
            yield pa.RecordBatch.from_arrays([b.column(seq), b.column("doc"), b.column("t"), pa.array(list(out), pa.list_(pa.float64()))], names=[seq, "doc", "t", "y"])

    kind = df.schema[seq].dataType.simpleString()
    rows = df.select(seq, F.col("doc").cast("bigint"), F.col("t").cast("bigint"), F.col("la").cast("double"), *[F.col(c).cast("array<double>") for c in "qkv"])
    return rows.repartition(seq).sortWithinPartitions(seq, "doc", "t").mapInArrow(scan, f"`{seq}` {kind}, doc bigint, t bigint, y array<double>")
