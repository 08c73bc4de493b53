"""Splits by a hash, checks that they are stratified, averages of weights, and rates of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import detect_language


def hash_split(key: Column, parts: int) -> Column:
    """0 .. parts - 1 by the first 32 bits of the key's MD5: the same in any order, on any machine and in SQL."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(parts)).cast("int")


def split_balance(df: DataFrame, split: str, stratum: str) -> DataFrame:
    """(stratum, split, n, share): rows of each stratum in each split, and their share of the stratum. A split by position
    of sorted rows shows as shares of 0 and 1."""
    n = df.groupBy(stratum, split).agg(F.count("*").alias("n"))
    total = n.groupBy(F.col(stratum).alias("_s")).agg(F.sum("n").alias("_n"))  # one row a stratum
    return n.join(total, F.col(stratum).eqNullSafe(F.col("_s"))).select(stratum, split, "n", (F.col("n") / F.col("_n")).alias("share"))


def average_weights(elements: DataFrame) -> DataFrame:
    """(name, i, value): the mean over checkpoints of (checkpoint, name, i, value)."""
    return elements.groupBy("name", "i").agg(F.avg("value").alias("value"))


def reply_rates(replies: DataFrame, by: str, reply: str, lang: str, expected: str, looped: str) -> DataFrame:
    """(by, n, script_ok, loop_rate, exact): replies in the script of their language, with a repeated n-gram, and as expected."""
    ok = detect_language(F.col(reply)) == F.col(lang)
    return replies.groupBy(by).agg(F.count("*").alias("n"), F.avg(ok.cast("int")).alias("script_ok"), F.avg(F.col(looped).cast("int")).alias("loop_rate"), F.avg((F.col(reply) == F.col(expected)).cast("int")).alias("exact"))
