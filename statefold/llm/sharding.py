"""Sharding by jump consistent hashing, as column expressions.

Jump hashing (Lamping and Veach, 2014) needs no ring table: the key alone decides the shard, and adding a shard at the
end moves only the rows that the new shard takes. Texts are read once for their size and CRC and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import gapless_rank

# Fixed values of the published algorithm: the multiplier of its 64-bit linear congruential generator; the increment is 1.
MULTIPLIER = 2862933555777941757
_MASK = 0xFFFFFFFF


def _low_product(a: Column, m: Column) -> Column:
    """a * m modulo 2**32 for unsigned 32-bit values, within a signed long."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(a, 16)
    return (low * m + F.shiftleft((high * m).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def _top31(high: Column, low: Column, step: Column) -> Column:
    """Top 31 bits of (high, low) * multiplier + increment modulo 2**64, by 32-bit halves of both.

    No intermediate value passes 2**62, so overflow checks of ANSI mode never fire.
    """
    p0, p1 = low.bitwiseAND(F.lit(0xFFFF)) * step.m_low, F.shiftrightunsigned(low, 16) * step.m_low
    tail = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + step.a_low
    carry = F.shiftrightunsigned(tail, 32) + F.shiftrightunsigned(p1, 16)
    top = carry + _low_product(low, step.m_high) + _low_product(high, step.m_low) + step.a_high
    return F.shiftrightunsigned(top.bitwiseAND(F.lit(_MASK)), 1)


def with_jump_hash(df: DataFrame, key: Column, shards: int, out: str, grown: str | None = None) -> DataFrame:
    """df with out: the shard 0 .. shards-1 of a bigint key (null counts as 0); grown: the shard if there were one more.

    The i-th state of the generator is key * M**i + C_i with known constants, so a chain is a fold over a constant array.
    The fold keeps the place just reached (at) and the last place below either shard count; at most shards + 1 jumps.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    n = shards + 1
    mult, add, steps = 1, 0, []
    for _ in range(n):
        mult, add = (mult * MULTIPLIER) % (1 << 64), (add * MULTIPLIER + 1) % (1 << 64)
        steps.append(F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in (("m_high", mult >> 32), ("m_low", mult & _MASK), ("a_high", add >> 32), ("a_low", add & _MASK))]))
    zero = F.lit(0).cast("bigint")

    def jump(acc: Column, step: Column) -> Column:
        r = _top31(F.col("_high"), F.col("_low"), step)
        to = F.floor((acc.at + 1).cast("double") * (F.lit(2147483648.0) / (r + 1).cast("double")))
        at = F.when(acc.at < n, to).otherwise(acc.at)
        return F.struct(at.alias("at"), F.when(at < shards, at).otherwise(acc.within).alias("within"), F.when(at < n, at).otherwise(acc.wider).alias("wider"))

    k = F.coalesce(key.cast("bigint"), zero)
    halves = df.withColumns({"_high": F.shiftrightunsigned(k, 32), "_low": k.bitwiseAND(F.lit(_MASK))})
    start = F.struct(zero.alias("at"), zero.alias("within"), zero.alias("wider"))
    done = halves.withColumn("_chain", F.aggregate(F.array(*steps), start, jump))
    done = done.withColumn(out, F.col("_chain.within").cast("int"))
    if grown:
        done = done.withColumn(grown, F.col("_chain.wider").cast("int"))
    return done.drop("_high", "_low", "_chain")


def shard_plan(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, size, text_crc32, law ('key'), shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 1. text_crc32: of the text (null: of no bytes, 0). slot: gapless
    from 0 in each shard, by key, then CRC and size; equal rows get different slots. Null keys share the shard of key 0. A text of
    any length is read whole, for its size and CRC.
    Other columns are not read; an empty table gives an empty result.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    placed = with_jump_hash(narrow, F.col("doc_id"), shards, "shard", "grown_shard")
    ranked = gapless_rank(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id", text: str = "text") -> None:
    """Write docs as Parquet in one folder for each shard (shard=0, shard=1, ...); rows stay where they were read."""
    raw = with_jump_hash(docs, F.col(key), shards, "shard")
    raw.write.mode("overwrite").partitionBy("shard").parquet(path)
